"""Entries of logs that arrive in pieces."""

import os

from timberline.operators.parse import parse_files
from timberline.options import ParseOptions
from timberline.sources.files import from_texts
from timberline.streaming import entries

PIECES = [
    {"1/a": ["before", "any", "2019-06-27T12:34:01Z FATAL one"], "2/a": ["2019-06-27T12:34:02Z WARN alone"], "3/a": ["no", "times"]},
    {"1/b": ["more", "of one"], "1/c": ["and more"], "1/d": ["the last of one", '{"ts":"2019-06-27T12:34:09Z","msg":"two"}', "2019-06-27T12:34:10Z three", ""], "3/b": ["at all"]},
    {"9/z": ["the others are silent"]},
]


def test_entries_across_pieces_and_restarts(spark, tmp_path):
    """The same as of whole files: entries over many pieces, before any start, with JSON; silence closes the last ones."""
    conf = {"spark.sql.streaming.stateStore.providerClass": entries.PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for wave in PIECES:
            for name, lines in wave.items():
                (tmp_path / f"in/log={name}").parent.mkdir(parents=True, exist_ok=True)
                (tmp_path / f"in/log={name}").write_text("".join(f"{x}\n" for x in lines))
            e = entries.entry_stream(entries.read_pieces(spark, str(tmp_path / "in"), "log=([0-9]+)"), idle_ms=1)
            q = e.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
            assert q.awaitTermination(120)
    finally:
        for k in conf:
            spark.conf.unset(k)
    got = sorted((r.log, r.timestamp_ms or 0, r.severity, r.message, r.matched, tuple(r.lines)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    texts = [(n, "\n".join(x for wave in PIECES for k, lines in wave.items() if k.startswith(n) for x in lines)) for n in "123"]
    want = sorted((texts[r.file_index][0], r.timestamp_ms or 0, r.severity, r.message, r.matched, tuple(r.lines)) for r in parse_files(from_texts(spark, texts), ParseOptions()).collect())
    assert got == want
    assert len(got) == 4 + 1 + 1


def test_a_backlog_is_read_in_the_order_of_its_paths(spark, tmp_path):
    """Many pieces at once, the later ones written first: each continuation stays with its entry."""
    (tmp_path / "in/log=1").mkdir(parents=True)
    n = 1001
    for i in range(n):
        f = tmp_path / f"in/log=1/{i:05d}"
        f.write_text(f"2019-06-27T12:34:56Z WARN n{i}\n" if i % 2 == 0 else f"more of n{i - 1}\n")
        os.utime(f, (1_561_638_896 - i, 1_561_638_896 - i))
    conf = {"spark.sql.streaming.stateStore.providerClass": entries.PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for wave in range(2):
            e = entries.entry_stream(entries.read_pieces(spark, str(tmp_path / "in"), "log=([0-9]+)"), ParseOptions(json_lines=False), idle_ms=1)
            q = e.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
            assert q.awaitTermination(120)
            (tmp_path / "in/log=2").mkdir(exist_ok=True)
            (tmp_path / "in/log=2/z").write_text("silence\n")
    finally:
        for k in conf:
            spark.conf.unset(k)
    got = sorted(r.message for r in spark.read.parquet(str(tmp_path / "out")).where("log = '1'").collect())
    assert got == sorted([*(f"n{i}\nmore of n{i}" for i in range(0, n - 1, 2)), f"n{n - 1}"])
