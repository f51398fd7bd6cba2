from pyspark import StorageLevel

from streamlat.operators import parity, records
from streamlat.operators.parity import Labels


def labels_of(df):
    return sorted((r.seq, r.parity) for r in df.collect())


def test_sign_does_not_change_parity(typed):
    df = typed((-3, 1), (-2, 1), (0, 1), (5, 1), (-2**63, 1), (2**63 - 1, 1))
    want = [(-2**63, "even"), (-3, "odd"), (-2, "even"), (0, "even"), (5, "odd"),
            (2**63 - 1, "odd")]
    assert labels_of(df.transform(parity.with_parity)) == want
    assert labels_of(df.transform(parity.label_union)) == want


def test_a_record_without_number_is_in_neither_half(typed):
    df = typed((None, 1), (1, 1))
    assert labels_of(df.transform(parity.with_parity)) == [(1, "odd")]
    assert labels_of(df.transform(parity.label_union)) == [(1, "odd")]


def test_duplicates_are_kept(typed):
    df = typed((1, 1), (1, 1), (2, 1))
    assert labels_of(df.transform(parity.label_union)) == [(1, "odd"), (1, "odd"), (2, "even")]


def test_other_labels(typed):
    df = typed((1, 1), (2, 1)).transform(parity.with_parity, Labels("o", "e"))
    assert labels_of(df) == [(1, "o"), (2, "e")]
    assert parity.THROUGHPUT_LABELS == ("odd0000", "even1111")


def test_key_and_value(lines):
    df = (lines("7 100").transform(records.parse_lines).transform(records.unit_count)
          .transform(parity.with_parity).transform(parity.key_by_parity))
    row = df.collect()[0]
    assert (row.parity, row.value.line, row.value.n) == ("odd", "7 100", 1)


def test_shared_records_are_cached(typed):
    df = parity.share(typed((1, 1), (2, 1)))
    assert df.storageLevel.useMemory and df.storageLevel.useDisk
    held = parity.share(typed((3, 1)), StorageLevel.MEMORY_ONLY)
    assert held.storageLevel.useMemory and not held.storageLevel.useDisk
    held.unpersist()
    assert labels_of(df.transform(parity.label_union)) == [(1, "odd"), (2, "even")]
    df.unpersist()


def test_rescale(typed):
    df = typed(*[(i, i) for i in range(100)]).coalesce(1)
    spread = df.transform(records.rescale, 4)
    assert spread.rdd.getNumPartitions() == 4
    assert sorted(r.seq for r in spread.collect()) == list(range(100))
