import hashlib
import io
import json
import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from siftline import cli
from siftline.functions import ngrams
from siftline.operators import index as ix
from siftline.operators import search as op
from siftline.plans.planner import decompose
from siftline.plans.regex import InvalidPattern
from siftline.sources import tree
from siftline.sources.tables import table_corpus
from siftline.streaming.upsert import apply_changes, index_stream

FILES = {
    "src/a.rs": "fn hello() {\n    42\n}\nHello World\n", "src/b.rs": "hello there add i32", "doc.md": "say hello\n\nhello again\r\n", "_x.txt": "underscore hello",
    "c.txt": "ab\n", "d.txt": "x\nhello\nend", "e.txt": "É Kelvin ſ ést\ntab\there \"q\" \\ \x01", "f.txt": "abc\n",
}
PATTERNS = [
    ("hello", False), ("Hello", False), ("hello", True), ("HELLO", True), ("ab|hello", False), ("(hello)?", False), ("^hello", False), ("x*", False), ("b*", False), ("end$", False),
    (r"\d+", False), ("hello.*there", False), ("zzzzqqqq", False), ("é", True), ("k", True), ("s", True), ("i?32", False), ("[a-z]+", False), ("tab\there", False), ("", False),
]


@pytest.fixture()
def folder(tmp_path):
    for name, text in FILES.items():
        p = tmp_path / "t" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    return tmp_path / "t"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_index_never_changes_an_answer(spark, folder, tmp_path):
    corpus = tree.tree_corpus(spark, str(folder))
    ix.build(spark, str(tmp_path / "ix"), corpus)
    index = ix.Index.open(spark, str(tmp_path / "ix"))
    for pattern, ignore in PATTERNS:
        want = rows(op.brute(corpus, pattern, ignore))
        assert rows(ix.search(index, corpus, pattern, ignore, scan_share=2.0)) == want, pattern
    assert rows(ix.search(index, corpus, "hello")) == rows(op.brute(corpus, "hello"))
    got = {(os.path.basename(r[0]), r[1]) for r in rows(ix.search(index, corpus, "Hello"))}
    assert got == {("a.rs", 4)}
    assert {os.path.basename(r[0]) for r in rows(ix.search(index, corpus, "ab|hello"))} == {"a.rs", "b.rs", "doc.md", "_x.txt", "c.txt", "d.txt", "f.txt", "e.txt"}
    assert {(os.path.basename(r[0]), r[1]) for r in rows(ix.search(index, corpus, "^hello"))} == {("b.rs", 1), ("d.txt", 2), ("doc.md", 3)}
    assert index.file_count() == len(FILES) == index.files().count()
    assert index.posting_count() == index.postings().count()
    gram = index.postings().first()["gram"]
    assert index.has_ngram(gram) and not index.has_ngram(12345)
    assert index.postings_of(gram).count() >= 1
    assert {r["gram"]: r["n"] for r in index.counts().collect()}[gram] == index.postings_of(gram).count()
    one = index.files().first()
    assert index.file_path(one["file_id"]) == one["path"] and index.file_meta(one["file_id"]) == (one["mtime"], one["size"])
    plan = decompose("hello.*there")
    assert index.candidates(plan).count() <= index.bound(plan) <= index.file_count()


def test_lines_and_submatches(spark):
    df = spark.createDataFrame([(1, "a\n"), (2, None), (3, "end\r\n"), (4, "abc"), (5, "éxé hello hello")], "id int, t string")
    corpus = table_corpus(df, ["id"], "t")
    assert [(r["path"], r["line_number"]) for r in op.in_order(op.brute(corpus, "x*")).collect()] == [("1", 1), ("1", 2), ("2", 1), ("3", 1), ("3", 2), ("4", 1), ("5", 1)]
    assert rows(op.brute(corpus, "end$")) == []
    sub = lambda p: {r["path"]: [(s["start"], s["end"]) for s in r["submatches"]] for r in op.brute(corpus, p, with_submatches=True).collect()}
    assert sub("b*")["4"] == [(0, 0), (1, 2), (3, 3)]
    assert sub("el+")["5"] == [(7, 10), (13, 16)]
    assert sub("é")["5"] == [(0, 2), (3, 5)]
    marked = table_corpus(spark.createDataFrame([(1, "﷐a﷑b")], "id int, t string"), ["id"], "t")
    assert [tuple(s) for s in op.brute(marked, "[ab]", with_submatches=True).first()["submatches"]] == [(3, 4), (7, 8)]


def test_json_lines(spark):
    text = 'q"\\ \t\x01\x08é/'
    corpus = table_corpus(spark.createDataFrame([("p", text)], "id string, t string"), ["id"], "t")
    line = op.json_lines(op.brute(corpus, "q", with_submatches=True)).first()[0]
    assert line == '{"path":"p","line_number":1,"line":"q\\"\\\\ \\t\\u0001\\u0008é/","submatches":[{"start":0,"end":1}]}'
    assert json.loads(line)["line"] == text


def test_compat_precheck(spark):
    corpus = table_corpus(spark.createDataFrame([(1, "x\nhello\n"), (2, "hello\nx\nhello\n")], "id int, t string"), ["id"], "t")
    assert {(r[0], r[1]) for r in rows(op.brute(corpus, "^hello"))} == {("1", 2), ("2", 1), ("2", 3)}
    assert {(r[0], r[1]) for r in rows(op.brute(corpus, "^hello", compat_precheck=True))} == {("2", 1), ("2", 3)}


def test_update_equals_rebuild(spark, tmp_path):
    def corpus(texts, mtime=1):
        df = spark.createDataFrame([(k, mtime if isinstance(mtime, int) else mtime[k], v) for k, v in texts.items()], "id string, m long, t string")
        return table_corpus(df, ["id"], "t", F.col("m"))

    root = str(tmp_path / "ix")
    first = {f"f{i}": f"common words {i} here" for i in range(12)}
    ix.build(spark, root, corpus(first))
    same = ix.update(spark, root, corpus(first))
    assert same.reused_files == 12 and same.bytes_read == 0
    later = {k: v for k, v in first.items() if k != "f3"} | {"f1": "changed text entirely", "new": "brand new words"}
    times = {k: 2 if k in ("f1", "f5") else 1 for k in later}
    stats = ix.update(spark, root, corpus(later, times))
    assert stats.files == 12 and stats.reused_files == 10
    updated = rows(ix.Index.open(spark, root).postings())
    ix.build(spark, str(tmp_path / "fresh"), corpus(later, times))
    assert updated == rows(ix.Index.open(spark, str(tmp_path / "fresh")).postings())
    assert ix.update(spark, root, corpus({})).files == 0
    assert ix.Index.open(spark, root).file_count() == 0


def test_damage_is_noticed(spark, tmp_path):
    root = str(tmp_path / "ix")
    corpus = table_corpus(spark.createDataFrame([(1, "hello world")], "id int, t string"), ["id"], "t")
    with pytest.raises(FileNotFoundError):
        ix.Index.open(spark, root)
    ix.build(spark, root, corpus)
    (tmp_path / "ix" / "v1" / "MANIFEST.json").write_text("{")
    for p in (tmp_path / "ix" / "v1").glob(".MANIFEST*.crc"):
        p.unlink()
    with pytest.raises(ix.CorruptIndex):
        ix.Index.open(spark, root)
    assert ix.update(spark, root, corpus).files == 1
    assert ix.Index.open(spark, root).file_count() == 1
    (tmp_path / "ix" / "CURRENT").write_text("junk")
    for p in (tmp_path / "ix").glob(".CURRENT*.crc"):
        p.unlink()
    with pytest.raises(ix.CorruptIndex):
        ix.Index.open(spark, root)


def test_scanner(tmp_path):
    def put(name, content=b"text"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)

    for name in ("a.txt", "_x.txt", ".hidden", "node_modules/m.js", "sub/build", "sub/k.PNG", "sub/keep.me", "sub/no.me", "ign/x.txt", "ign/keep.txt", "deep/secret/y", "z.tmp", "own.dat", "exact", "b c.txt"):
        put(name)
    put("empty", b"")
    put("max", b"x" * (1 << 20))
    put("over", b"x" * ((1 << 20) + 1))
    put("nul", b"ab\0c")
    put(".gitignore", b"*.tmp\nign/*\n!ign/keep.txt\n/exact\ndeep/**/y\n# note\n")
    put("sub/.gitignore", b"*.me\n!keep.me\n")
    put(".siftlineignore", b"own.dat\n")
    os.symlink(tmp_path / "a.txt", tmp_path / "link.txt")
    os.symlink(tmp_path, tmp_path / "loop")
    names = lambda o: {os.path.relpath(p, os.path.realpath(tmp_path)) for p, _, _ in tree.scan(str(tmp_path), o)}
    assert names(tree.ScanOptions()) == {"a.txt", "_x.txt", "sub/keep.me", "ign/keep.txt", "max", "b c.txt"}
    assert names(tree.ScanOptions(follow_symlinks=True)) == {"a.txt", "_x.txt", "sub/keep.me", "ign/keep.txt", "max", "b c.txt", "link.txt"}
    assert "over" in names(tree.ScanOptions(max_file_size=1 << 21))
    assert tree.read_file(str(tmp_path / "nul")) is None and tree.read_file(str(tmp_path / "gone")) is None
    assert tree.scan(str(tmp_path / "nowhere")) == []


def test_tasks_walk_what_the_driver_does_not(spark, tmp_path, monkeypatch):
    for k in range(40):
        p = tmp_path / "t" / f"d{k % 5}" / f"e{k % 7}" / f"f{k}.txt"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"text {k}")
    (tmp_path / "t" / "d1" / ".gitignore").write_text("e2/\nf6.txt\n!f1.txt\n")
    want = tree.scan(str(tmp_path / "t"))
    assert 30 < len(want) < 40
    for tasks in (1, 3, 1000):
        monkeypatch.setattr(tree, "TASKS", tasks)
        parts = tree.TreeReader(str(tmp_path / "t"), tree.ScanOptions()).partitions()
        got = [f for p in parts for f in tree.TreeReader("", tree.ScanOptions()).read(p)]
        assert sorted(got) == sorted(want) and any(p.folders for p in parts) == (tasks < 1000)
    assert {(r["path"], bytes(r["content"]).decode()) for r in tree.tree_corpus(spark, str(tmp_path / "t")).collect()} == {(p, open(p).read()) for p, _, _ in want}


def test_ignore_rules_from_outside(tmp_path, monkeypatch):
    home, repo = tmp_path / "home", tmp_path / "repo"
    for p in (home / ".config" / "git", repo / ".git" / "info", repo / "sub"):
        p.mkdir(parents=True)
    for name in ("a.txt", "a.bak", "a.own", "a.usr", "b.up"):
        (repo / "sub" / name).write_text("x")
    monkeypatch.setenv("HOME", str(home))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    names = lambda: {os.path.basename(p) for p, _, _ in tree.scan(str(repo / "sub"))}
    assert len(names()) == 5
    (home / ".config" / "git" / "ignore").write_text("*.bak\n")
    (repo / ".git" / "info" / "exclude").write_text("/sub/*.own\n")
    (repo / ".gitignore").write_text("*.up\n")
    assert names() == {"a.txt", "a.usr"}
    (home / "mine").write_text("*.usr\n")
    (home / ".gitconfig").write_text("[user]\nname = x\n[core]\n\texcludesFile = ~/mine\n")
    assert names() == {"a.txt", "a.bak"}
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "xdg"))
    (home / ".gitconfig").unlink()
    (tmp_path / "xdg" / "git").mkdir(parents=True)
    (tmp_path / "xdg" / "git" / "ignore").write_text("a.txt\n")
    assert names() == {"a.bak", "a.usr"}


def run(spark, *args):
    out, err = io.StringIO(), io.StringIO()
    return cli.execute(list(args), out, err, lambda: spark), out.getvalue(), err.getvalue()


def test_command_line(spark, folder):
    at = str(folder)
    code, out, err = run(spark, "--stats", "--time", "hello", at)
    assert code == 0 and "siftline: build: 8 files (0 reused)" in err and "matches" in err and "total" in err
    assert out.splitlines() == run(spark, "--no-index", "hello", at)[1].splitlines()
    assert out.splitlines()[0].endswith("_x.txt:1:underscore hello")
    assert run(spark, "zzzzqqqq", at)[0] == 1
    assert run(spark, "a" + "+" * 2000, at)[0] == 2 and run(spark, "(" * 400 + "a" + ")" * 400, at)[0] == 2 and run(spark, "(" * 100 + "hello" + ")" * 100, at)[0] == 0
    assert run(spark, "(", at)[0] == 2 and run(spark, "--nope", "x", at)[0] == 2 and run(spark)[0] == 2
    assert run(spark, "--help")[0] == 0
    assert {"path", "line_number", "line", "submatches"} == set(json.loads(run(spark, "--json", "el+", at)[1].splitlines()[0]))
    (folder / "new.txt").write_text("hello fresh")
    assert "fresh" not in run(spark, "hello", at)[1]
    code, out, err = run(spark, "--update", "--stats", "hello", at)
    assert "fresh" in out and "9 files (8 reused)" in err
    (folder / ".siftline" / "CURRENT").write_text("junk")
    (folder / ".siftline" / ".CURRENT.crc").unlink(missing_ok=True)
    assert run(spark, "hello", at)[0] == 2
    assert run(spark, "--build", "hello", at)[0] == 0
    assert cli.parse_args(["--", "-i"]).pattern == "-i" and cli.parse_args(["-", "p"]).path == "p"


def test_invalid_pattern(spark):
    with pytest.raises(InvalidPattern):
        op.brute(table_corpus(spark.createDataFrame([(1, "a")], "id int, t string"), ["id"], "t"), "(?=a)")


def test_stream_of_changes(spark, tmp_path):
    schema = "path string, mtime long, size long, content string"
    root = str(tmp_path / "ix")
    spark.createDataFrame([("a", 1, 5, "hello one"), ("b", 1, 5, "hello two")], schema).write.parquet(str(tmp_path / "in" / "1"))
    spark.createDataFrame([("a", 2, 5, "goodbye"), ("c", 2, 5, "hello three"), ("b", 2, 0, None)], schema).write.parquet(str(tmp_path / "in" / "2"))
    apply_changes(root, spark.read.parquet(str(tmp_path / "in" / "1")))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "2"))
    index_stream(stream, root, str(tmp_path / "cp")).start().awaitTermination(120)
    assert {r["path"] for r in ix.Index.open(spark, root).files().collect()} == {"a", "c"}


def test_repeated_paths(spark, tmp_path):
    """Rows that share a path are one file with the grams of all; updates of such tables equal a rebuild."""
    schema = "id string, m long, t string"
    rows = [("a", 1, "hello one"), ("a", 1, "goodbye two"), ("a", 1, "hello one"), (None, 2, "third words"), ("", 3, "fourth words"), ("b", 1, "hello five")]
    corpus = lambda rows: table_corpus(spark.createDataFrame(rows, schema), ["id"], "t", F.col("m"))
    root, later = str(tmp_path / "ix"), [*rows[:4], ("", 3, "changed words now"), ("c", 1, "hello six"), ("c", 2, "seven")]
    assert ix.build(spark, root, corpus(rows)).files == 3
    for step in (rows, later, later, rows, later):
        stats = ix.update(spark, root, corpus(step))
        index = ix.Index.open(spark, root)
        ix.build(spark, str(tmp_path / "fresh"), corpus(step))
        fresh = ix.Index.open(spark, str(tmp_path / "fresh"))
        assert rows_of(index.postings()) == rows_of(fresh.postings()) and rows_of(index.files()) == rows_of(fresh.files()) and rows_of(index.grams()) == rows_of(fresh.grams())
        assert rows_of(index.counts()) == rows_of(fresh.counts())
        assert (stats.files, stats.ngrams, stats.postings) == (fresh.file_count(), fresh.ngram_count(), fresh.posting_count())
        for p in ("hello", "words", "seven", "goodbye"):
            assert rows_of(ix.search(index, corpus(step), p, scan_share=2.0)) == rows_of(op.brute(corpus(step), p))
    assert stats.reused_files == 1


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_segments_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "MOST_SEGMENTS", 3)
    corpus = lambda k: table_corpus(spark.createDataFrame([(i, k if i < k else 0, f"text number {i} of {'old' if i >= k else f'new{k}'} words") for i in range(40)], "id long, m long, t string"), ["id"], "t", F.col("m"))
    root, many = str(tmp_path / "ix"), []
    ix.build(spark, root, corpus(0))
    for k in range(1, 6):
        stats = ix.update(spark, root, corpus(k))
        index = ix.Index.open(spark, root)
        many.append(len(index.manifest["segments"]))
        assert stats.files == 40 and stats.reused_files == 40 - k and index.files().count() == 40
        assert rows_of(ix.search(index, corpus(k), f"new{k}", scan_share=2.0)) == rows_of(op.brute(corpus(k), f"new{k}"))
        assert index.postings().count() == index.posting_count() and index.counts().count() == index.ngram_count()
    assert many == [2, 3, 1, 2, 3] and len(os.listdir(f"{root}/segments")) <= 5


def test_looked_up_by_key_and_by_shuffle(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"word{i % 7} text{i} {'needle' if i % 50 == 3 else 'hay'}") for i in range(300)] + [(None, "needle without key")], "id long, t string")
    corpus, root = table_corpus(df, ["id"], "t"), str(tmp_path / "ix")
    ix.build(spark, root, corpus)
    index = ix.Index.open(spark, root)
    for name, value in (("KEYED_FILES", 0), ("KEYED_IDS", 0), ("LISTED_IDS", 3), ("HELD_GRAMS", 0), ("DRIVER_POSTINGS", 0)):
        monkeypatch.setattr(ix, name, value)
        for pattern in ("needle", "needle|word3", "text1.*hay", "text29[0-9] hay", "zzzzzz", "word6.*needle"):
            assert rows_of(ix.search(index, corpus, pattern, scan_share=2.0)) == rows_of(op.brute(corpus, pattern)), (name, pattern)


@pytest.mark.parametrize("table", ["counts", "postings", "files", "grams"])
def test_damaged_tables_are_noticed(spark, tmp_path, table):
    root = tmp_path / "ix"
    corpus = table_corpus(spark.createDataFrame([(i, f"hello world {i}") for i in range(30)], "id int, t string"), ["id"], "t")
    ix.build(spark, str(root), corpus)
    part = max((root / "segments" / "s1" / table).glob("part-*.parquet"), key=lambda p: p.stat().st_size)
    whole = part.read_bytes()
    for p in part.parent.glob(f".{part.name}.crc"):
        p.unlink()
    for damaged in (whole[:-20], whole + b"x", None):
        part.write_bytes(damaged) if damaged is not None else part.unlink()
        with pytest.raises(ix.CorruptIndex):
            ix.Index.open(spark, str(root))
    assert ix.update(spark, str(root), corpus).reused_files == 0 and ix.Index.open(spark, str(root)).file_count() == 30


def test_late_rows_of_a_stream(spark, tmp_path):
    root, schema = str(tmp_path / "ix"), "path string, mtime long, size long, content string"
    put = lambda *rows: apply_changes(root, spark.createDataFrame(list(rows), schema))
    state = lambda: {(r["path"], r["mtime"], r["content_hash"][:8]) for r in ix.Index.open(spark, root).grams().collect()}
    of = lambda t: hashlib.sha256(t.encode()).hexdigest()
    put(("a", 5, 3, "new"), ("a", 1, 3, "old"), ("b", 2, 1, "b"), (None, 9, 1, "x"))
    assert put(("a", 1, 3, "old"), ("a", 4, 0, None)) is None and state() == {("a", 5, of("new")[:8]), ("b", 2, of("b")[:8])}
    tie = max("one", "two", key=of)
    put(("b", 3, 3, "two"), ("b", 3, 3, "one"))
    assert put(("b", 3, 3, min("one", "two", key=of)), ("b", 3, 0, None)) is None and ("b", 3, of(tie)[:8]) in state()
    put(("a", 6, 0, None))
    assert put(("a", 6, 0, None)) is None and put(("a", 5, 3, "new")) is None and state() == {("b", 3, of(tie)[:8])}
    assert ix.Index.open(spark, root).file_count() == 1 == ix.Index.open(spark, root).files().count()
    put(("a", 7, 4, "back"))
    assert {p for p, _, _ in state()} == {"a", "b"} and ix.Index.open(spark, root).postings().count() == ix.Index.open(spark, root).posting_count()
    final = table_corpus(spark.createDataFrame([("a", "back"), ("c", "c's text")], "id string, t string"), ["id"], "t")
    assert ix.update(spark, root, final).files == 2 and {p for p, _, _ in state()} == {"a", "c"}


def test_dense_ids_of_many_paths(spark, tmp_path):
    """Ranges hold the same rows when they are counted and when they are numbered; null ids have a null path and come last."""
    from siftline.plans import queries

    ids = [None, None, *((i * 7919) % 200_003 - 1000 for i in range(120_000)), 5, 5]
    spark.createDataFrame([(i, "") for i in ids], "doc_id long, text string").repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = sorted((r["file_id"], r["path"]) for r in queries.QUERIES["dense_file_ids"](spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == list(enumerate([*sorted(str(i) for i in ids if i is not None), None, None]))
    assert op.file_ids(spark.createDataFrame([], "path string, x int")).count() == 0


def test_postings_are_small(spark, tmp_path, monkeypatch):
    """A posting takes few bytes, whatever it costs to say its gram and file; counts are the same by one range of grams and by many."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(2000)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(600)]
    corpus, root = table_corpus(spark.createDataFrame(texts, "id long, t string").repartition(2), ["id"], "t"), str(tmp_path / "ix")
    stats = ix.build(spark, root, corpus)
    counts = rows_of(ix.Index.open(spark, root).counts())
    assert stats.index_bytes < 6 * stats.postings and len(counts) == stats.ngrams
    monkeypatch.setattr(ix, "COUNTED", 10_000)
    many = ix.build(spark, root, corpus)
    index = ix.Index.open(spark, root)
    assert (many.postings, many.ngrams) == (stats.postings, stats.ngrams) and rows_of(index.counts()) == counts
    assert index.postings().distinct().count() == stats.postings == index.rows().agg(F.sum("n_grams")).first()[0]


def test_chunks(monkeypatch):
    """Chunks are bounded, neighbours of one path are one file, and files that went leave no posting."""
    monkeypatch.setattr(ngrams, "CHUNK", 5000)
    monkeypatch.setattr(ngrams, "SORTED", 700)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["alpha", "beta", f"gamma{rng.randrange(500)}", "é"]) for _ in range(rng.randrange(200))) if i != 7 else None for i in range(200)]
    paths = [f"p{i // 2 if i % 10 < 2 else i + 1000}" for i in range(200)]

    def batch(a, b):
        same = {"mtime": 0, "size": 1, "content_hash": "h", "reused": False}
        return pa.RecordBatch.from_pylist([same | {"file_id": int(p[1:]), "path": p, "content": t and t.encode()} for p, t in zip(paths[a:b], texts[a:b], strict=True)])

    out = pa.Table.from_batches(list(ngrams.chunks_of_batches(iter([batch(0, 101), batch(101, 102), batch(102, 200)]))))
    docs = [r for r in out.to_pylist() if r["path"]]
    assert [r["path"] for r in docs] == paths and len({r["chunk"] for r in docs}) > 3
    path = {(r["chunk"], r["nth"]): r["path"] for r in docs}
    rows = out.filter(pa.compute.is_valid(out["gram"])).select(["chunk", "gram", "n", "ids"])
    of = lambda t, **o: [(r["chunk"], r["nth"], r["gram"]) for b in ngrams.places_of_batches(iter(t.to_batches()), **o) for r in b.to_pylist()]
    got = of(rows, most=1000)
    want = {(p, g) for p, t in zip(paths, texts, strict=True) if t for g in ngrams.gram_hashes(ngrams.fold(t.encode())).tolist()}
    assert len(got) == len(set(got)) == len(want) and {(path[c, n], g) for c, n, g in got} == want
    first = docs[0]["chunk"]
    assert of(rows, wanted={first: np.array([1, 2])}) == [x for x in got if x[0] == first and x[1] in (1, 2)]
    left = ngrams.grams_without(rows.filter(pa.compute.equal(rows["chunk"], first)), np.array([0, 3]))
    assert sorted(of(left)) == sorted(x for x in got if x[0] == first and x[1] not in (0, 3))
    places, begins = np.array([0, 1, 300, 70000, 5, 2**31 - 1, 0]), np.array([0, 4, 6])
    data, offsets = ngrams.encoded(places, begins)
    assert ngrams.decoded(ngrams._lists(data, offsets), np.array([4, 2, 1])).tolist() == places.tolist()


def test_a_chunk_costs_little_memory(monkeypatch):
    """Its grams are held once while it is written, in one array; a file larger than that, and more rows of it, find room."""
    monkeypatch.setattr(ngrams, "CHUNK", 1_000_000)
    monkeypatch.setattr(ngrams, "SORTED", 20_000)
    rng = random.Random(5)
    same = {"mtime": 0, "size": 1, "content_hash": "h", "reused": False, "file_id": 1}
    batch = pa.RecordBatch.from_pylist([same | {"path": f"p{i}", "content": bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz ", k=9000))} for i in range(60)])
    tracemalloc.start()
    try:
        n = sum(pa.compute.sum(b["n"]).as_py() or 0 for b in ngrams.chunks_of_batches(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert 700_000 < n < ngrams.CHUNK and peak < 18 * n
    monkeypatch.setattr(ngrams, "CHUNK", 2000)
    some = pa.RecordBatch.from_pylist([same | {"path": p, "content": t} for p, t in (("a", b"before"), ("b", batch["content"][0].as_py()), ("b", batch["content"][1].as_py()), ("c", b"after"))])
    out = pa.Table.from_batches(list(ngrams.chunks_of_batches(iter([some]))))
    want = sum(len({g for t in ts for g in ngrams.gram_hashes(t).tolist()}) for ts in ([b"before"], batch["content"].to_pylist()[:2], [b"after"]))
    assert pa.compute.sum(out["n"]).as_py() == want and len(set(out["chunk"].to_pylist())) == 2
