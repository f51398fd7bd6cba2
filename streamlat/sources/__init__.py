"""Where lines come from: topics, sockets, files, generated load, tables."""
