"""Where results go. Each function gives a DataStreamWriter for `streaming.run.start`."""
