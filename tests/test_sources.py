"""Request reader (A2), filter sink (A6) and phrase files (A1)."""

import json
import os
import tempfile

import pytest

from fretelens.operators.parse import parse_requests
from fretelens.session import checkpoint_dir
from fretelens.sources.phrases import read_phrase_files
from fretelens.sources.requests import read_requests
from fretelens.sources.sinks import read_filters, write_filters


def _folder(spark, name):
    return tempfile.mkdtemp(prefix=name, dir=checkpoint_dir(spark))


def test_request_reader_keeps_bad_rows_for_the_gate(spark):
    d = _folder(spark, "req")
    with open(os.path.join(d, "r.json"), "w", encoding="utf-8") as f:
        f.write(json.dumps({"request_id": 1, "ts": "2025-10-22T10:00:00", "user_id": 3,
                            "query": "notas rodando"}) + "\n")
        f.write(json.dumps({"request_id": 2, "ts": "2025-10-22T10:00:00", "user_id": 3, "query": 55}) + "\n")
        f.write("{not json\n")
    df = read_requests(spark, d)
    rows = {r.request_id: r for r in df.collect()}
    assert rows[1].query == "notas rodando"
    out = {r.request_id: r.outcome for r in parse_requests(df.drop("_corrupt_record")).collect()}
    assert out[1] == "ok"
    assert sum(1 for r in df.collect() if r._corrupt_record is not None) >= 1


def test_filter_sink_partitions_by_outcome(spark):
    df = spark.createDataFrame([(1, None, 0, "notas rodando"), (2, None, 0, "me mostre as notas"), (3, None, 0, "")],
                               "request_id bigint, ts timestamp_ntz, user_id bigint, query string")
    p = parse_requests(df)
    d = _folder(spark, "sink")
    write_filters(p, d)
    assert sorted(x for x in os.listdir(d) if x.startswith("outcome=")) == [
        "outcome=empty", "outcome=ok", "outcome=vague"]
    ok = read_filters(spark, d, "ok").collect()
    assert len(ok) == 1 and json.loads(ok[0].filter_json)["SituacaoNF"] == "TRÂNSITO"
    assert len(json.loads(ok[0].filter_json)) == 14


def test_phrase_files(spark):
    d = _folder(spark, "phr")
    with open(os.path.join(d, "t.txt"), "w", encoding="utf-8") as f:
        f.write("# cabeçalho\n=====\n\n  notas rodando # nota inline\nnf 123\n")
    rows = [(r.line_no, r.text) for r in read_phrase_files(spark, d).orderBy("line_no").collect()]
    assert rows == [(4, "notas rodando # nota inline"), (5, "nf 123")]


LOG = ("não é um registro\n"
       "2025-10-22 10:00:00,123 - app.main - INFO - Recebida nova requisição\n"
       "2025-10-22 10:00:01,000 - app.main - ERROR - Erro no endpoint\n"
       "Traceback (most recent call last):\n"
       "\n"
       "ValueError: x\n"
       "2025-10-22 10:00:02,500 - app.main - WARNING - Consulta vaga\n")


def _big_log(n):
    """Records of many sizes: tracebacks, blank lines, CRLF, text that looks like half a header."""
    out = [LOG]
    for i in range(n):
        end = "\r\n" if i % 4 == 3 else "\n"
        out.append(f"2025-10-23 {i // 3600 % 24:02d}:{i // 60 % 60:02d}:{i % 60:02d},{i % 1000:03d} - app.x{i % 3} - {['INFO', 'ERROR', 'DEBUG'][i % 3]} - mensagem é {'x' * (i * 7 % 90)}{end}")
        if i % 3 == 1:
            out.append("Traceback:" + end + f"  2025-10-23 00:00:00,000 - recuado{end}2025-10-23 sem cabeçalho{end}" + "é linha" * (i % 50) + end + end)
    return "".join(out)


def _fold(text):
    """The records of a log, line by line."""
    import re
    out = []
    for line in re.split(r"\r?\n", text):
        m = re.match(r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (\S+) - (DEBUG|INFO|WARNING|ERROR|CRITICAL) - (.*)$", line)
        if m:
            out.append([m[1].replace(",", "."), m[2], m[3], m[4]])
        elif out and line:
            out[-1][3] += "\n" + line
    return [tuple(r) for r in out]


@pytest.mark.parametrize("split", [37, 1024, 1 << 20])
def test_log_files_in_splits(spark, tmp_path, split, monkeypatch):
    """Whatever the splits, every record comes once and whole, numbered through its file."""
    from fretelens.sources.log_reader import scan_logs
    texts = {"a.log": LOG if split < 100 else _big_log(900), "a.log.1": _big_log(40)[:-1], "empty.log": "", "none.log": "no header\nat all\n", "skip.txt": LOG}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = {}
    for r in scan_logs(spark, f"{tmp_path}/*.log*", split).orderBy("file", "record_no").collect():
        got.setdefault(os.path.basename(r.file), []).append((r.record_no, r.ts.strftime("%Y-%m-%d %H:%M:%S.%f")[:-3], r.logger, r.level, r.message))
    assert got == {k: [(i, *r) for i, r in enumerate(_fold(t), 1)] for k, t in texts.items() if _fold(t) and k != "skip.txt"}


def test_log_splits_are_dealt_into_few_tasks(spark, tmp_path):
    """Many small splits and files take a few tasks, and records are numbered on where a file is cut between tasks."""
    from fretelens.sources.log_reader import dealt, scan_logs
    texts = {f"{k}.log": _big_log(30 + k) for k in range(40)} | {"long.log": _big_log(4000)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    cores = spark.sparkContext.defaultParallelism
    sizes = [(k, len(t.encode())) for k, t in texts.items()]
    cut = [r for t in dealt(sizes, 512, 4 * cores) for r in t.runs]
    assert {f: sum(e - s for g, s, e, _ in cut if g == f) for f, _ in sizes} == dict(sizes) and sum(f == "long.log" for f, *_ in cut) > 1
    rows = scan_logs(spark, f"{tmp_path}/*.log", 512)
    assert rows.rdd.getNumPartitions() <= 8 * cores < sum(z for _, z in sizes) // 512
    got = {}
    for r in rows.orderBy("file", "record_no").collect():
        got.setdefault(os.path.basename(r.file), []).append((r.record_no, r.ts.strftime("%Y-%m-%d %H:%M:%S.%f")[:-3], r.logger, r.level, r.message))
    assert got == {k: [(i, *r) for i, r in enumerate(_fold(t), 1)] for k, t in texts.items()}


def test_log_stream_waits_for_the_open_record(spark, tmp_path):
    """A growing file: the last record is held back until a header follows; nothing comes twice."""
    from fretelens.sources.log_reader import stream_logs
    folder, out, ckpt = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "ckpt")
    folder.mkdir()
    text = _big_log(120)
    cuts = [len(text) // 3, len(text) // 2 + 5, len(text)]

    def run(closed=False):
        q = stream_logs(spark, str(folder), 500, closed).writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).start()
        q.processAllAvailable()
        q.stop()
        return [(r.ts.strftime("%Y-%m-%d %H:%M:%S.%f")[:-3], r.logger, r.level, r.message) for r in spark.read.parquet(out).orderBy("pos").collect()]

    for z in cuts:
        (folder / "service.log").write_bytes(text[:z].encode())
        now = run()
        assert now == _fold(text)[: len(now)] and len(now) == len(_fold(text[:z])) - 1
    assert run(closed=True) == _fold(text)


def test_phrase_files_in_tiny_splits(spark, tmp_path):
    """Line numbers and sections run on across splits."""
    from fretelens.sources.lines import numbered_lines
    from fretelens.sources.phrases import read_suites
    lines, want, suite = [], [], (None, None)
    for i in range(300):
        if i % 41 == 7:
            suite = (i, f"grupo {i}")
            lines += ["# =====", f"# Suíte {i}: grupo {i}", "# ---"]
        if i % 11:
            lines.append(f"  nf {i} é # nota")
            want.append((len(lines), *suite, f"nf {i} é # nota"))
        else:
            lines.append("")
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("\r\n".join(lines) if name == "b.txt" else "\n".join(lines) + "\n", encoding="utf-8", newline="")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert numbered_lines(spark, str(tmp_path)).groupBy("file").count().count() == 2
        got = read_suites(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("a.txt", "b.txt"):
        assert sorted((r.line_no, r.suite_no, r.suite, r.text) for r in got if r.file.endswith(name)) == want


def test_sections_are_carried_over_empty_runs(spark):
    from fretelens.sources.phrases import suite_lines
    rows = [("f", i, "# Suíte 3: x" if i == 4 else f"nf {i}") for i in range(1, 40)] + [("g", 1, "nf 1")]
    got = {(r.file, r.line_no): r.suite_no for r in suite_lines(spark.createDataFrame(rows, "file string, line_no long, value string"), every=5).collect()}
    assert got == {("f", i): (3 if i > 4 else None) for i in range(1, 40) if i != 4} | {("g", 1): None}


def test_reader_twice_and_rejected_bodies(spark, tmp_path):
    from fretelens.operators.normalize import is_blank
    from fretelens.sources.requests import REQUEST_SCHEMA, read_requests
    from pyspark.sql import functions as F

    path = str(tmp_path / "r.json")
    with open(path, "w") as f:
        f.write('{"request_id": 1, "query": "nf 1"}\n{"request_id": 2, "query": 55}\n{"request_id": 3}\n{"request_id": 4, "query": {"a": "b"}}\nno json\n{"request_id": 6, "query": "a \\"b\\""}\n')
    before = REQUEST_SCHEMA.simpleString()
    for _ in range(2):
        got = read_requests(spark, path).withColumn("blank", is_blank(F.col("query"))).collect()
        assert {r.request_id: r.query for r in got if not r.blank} == {1: "nf 1", 6: 'a "b"'}
        assert sum(r.blank and r._corrupt_record is not None for r in got) == 4
    assert REQUEST_SCHEMA.simpleString() == before
