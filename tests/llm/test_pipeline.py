import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute

import corpus_pipeline as cp
from siftline.llm import jaccard, packing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(k, n=120):
    return "\n".join(" ".join(f"t{k}w{i * 7 + j}" for j in range(8)) for i in range(n // 8))


def test_stages_against_plain_versions(spark, tmp_path):
    passage = "\n".join(" ".join(f"shared{i}x{j}" for j in range(20)) for i in range(3))
    item = " ".join(f"exam{i}" for i in range(30))
    texts = {0: prose(0), 1: prose(0), 2: prose(2) + "\n" + passage, 3: prose(3) + "\n" + passage, 4: prose(4) + "\n" + item, 5: "short", 6: None, 7: "again and again " * 60, 8: prose(8), 9: prose(9, 6000)}
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, seen = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, d)
        assert name == "packing" or out.columns == list(cp.COLUMNS) and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        if name == "packing":
            assert {r["doc_id"] for r in docs.collect()} == set(before)
            break
        seen[name] = after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality_rules":
            assert after == {i: t for i, t in before.items() if not brute.measures(t)[-1]}
        if name == "line_dedup":
            left = brute.lines_left(before)
            assert after == {i: t for i, t in left.items() if t.strip() or t == before[i]}
        if name == "near_dedup":
            groups = brute.groups({i: brute.fingerprint(t) for i, t in before.items()})
            assert after == {i: t for i, t in before.items() if groups[i] == i}
        if name == "decontamination":
            found = {x[0] for x in brute.contained(before, {1: item})}
            assert found == {4} and after == {i: t for i, t in before.items() if i not in found}
    assert 5 not in seen["quality_rules"] and 7 not in seen["quality_rules"] and 1 not in seen["line_dedup"]
    assert sorted(r["length"] for r in cp.run(spark, d).collect()) == sorted(r["length"] for r in docs.collect())
    assert packing.WINDOW == 4096 and quality.FIT_ROWS > 0


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(2000)]
    text = lambda n=90: "\n".join(" ".join(rng.choice(words) for _ in range(9)) for _ in range(n // 9))
    a, b, c, d, item = text(), text(), text(), text(), text(36).replace("\n", " ")
    near = lambda t, k: t.replace(t.split()[40], f"changed{k}", 1)
    rows = [(None, a), (None, near(a, 1)), (3, near(a, 2)), (5, b), (5, c), (5, c), (5, None), (None, None), (7, ""), (8, d + " " + item), (None, text() + " " + item), (8, text()), (9, text(9) * 400), (None, near(b, 3))]
    docs = spark.createDataFrame([(i, t, None, "s" if k % 2 else None, None, "clash", k, "clash") for k, (i, t) in enumerate(rows)], SCHEMA + ", key string, h long, component_id string").repartition(3)
    at = str(tmp_path)
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(5, None, 0), (None, 1, 0), (8, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    of = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    left = lambda *gone: sorted((r for k, r in enumerate(rows) if k not in gone), key=str)
    assert of(cp.quality_rules(spark, docs, at)) == sorted(((i, t) for i, t in rows if not brute.measures(t)[-1]), key=str)
    # One of each group stays: the least id, null ids last.
    assert of(cp.near_dedup(spark, docs, at)) == left(0, 1, 13)
    assert of(cp.decontamination(spark, docs, at)) == left(9, 10)
    lines = cp.line_dedup(spark, docs, at)
    assert lines.count() <= len(rows) and (5, None) in of(lines) and (5, c) in of(lines) and lines.columns == list(cp.COLUMNS)
    assert sorted({r["doc_id"] for r in cp.packing_stage(spark, docs, at).collect()}, key=str) == sorted({i for i, _ in rows}, key=str)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, at).columns == list(cp.COLUMNS) and stage(spark, docs.limit(0), at).count() == 0


def pairs(docs):
    of = {r["h"]: r["text"] for r in docs.selectExpr("text", "xxhash64(text) h").collect()}
    return {tuple(sorted((of[r["a"]], of[r["b"]]))) for r in jaccard.links(docs).collect()}


def groups(edges, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in nodes}


def test_near_copies_go(spark):
    rng = random.Random(5)
    words, rows = [f"w{i}" for i in range(3000)], []
    for k in range(24):
        base = [rng.choice(words) for _ in range(rng.choice([60, 200, 700]))]
        rows.append((4 * k, " ".join(base)))
        for j, share in enumerate((0.01, 0.02, 0.04), 1):  # a changed word changes up to five shingles
            rows.append((4 * k + j, " ".join(f"new{k}x{j}x{i}" if rng.random() < share else w for i, w in enumerate(base))))
    rows += [(200, "too few words"), (201, "Too few, words"), (202, "too few word"), (203, ""), (204, None), (None, rows[0][1] + " more")]
    texts = dict(rows[:-1])
    shingles = {i: brute.shingles(t) for i, t in texts.items()}
    near = {(a, b) for a in texts for b in texts if a < b and shingles[a] and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])}
    assert len(near) > 20 and sum((brute.fingerprint(texts[a]) ^ brute.fingerprint(texts[b])).bit_count() > 2 for a, b in near) > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pairs(docs.where("doc_id IS NOT NULL"))
    assert got <= {tuple(sorted((texts[a], texts[b]))) for a, b in near if texts[a] != texts[b]}  # what is linked is similar
    full = docs.selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars")
    kept = {r["doc_id"] for r in cp.near_dedup(spark, full, "").collect()}
    assert kept & set(texts) and not [p for p in near if set(p) <= kept] and {200, 202, 203, 204} <= kept and 201 not in kept


def test_a_large_group_of_near_copies(spark):
    """Links grow with the texts, not with their square, and connect nearly all that similar pairs connect."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = [(k, " ".join(f"new{k}x{i}" if rng.random() < 0.015 else w for i, w in enumerate(base))) for k in range(400)]
    texts = {t for _, t in rows}
    s = {t: brute.shingles(t) for t in texts}
    near = [(a, b) for a in texts for b in texts if a < b and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])]
    got = pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(near) > 20 * len(texts) and len(got) <= jaccard.ROUNDS * len(texts) and got <= set(near)
    of = groups(got, texts)
    assert sum(of[a] == of[b] for a, b in near) > 0.97 * len(near)


def test_no_link_of_similar_texts_is_lost(spark):
    """Chains, whose ends no hub is similar to, and groups of changed copies: what similar pairs connect is connected."""
    rng = random.Random(8)
    rows = []
    for size, share in ((150, 0.02), (90, 0.03), (120, 0.025), (60, 0.012)):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([80, 150, 300]))]
        rows += [" ".join(f"new{len(rows)}x{k}x{i}" if rng.random() < share else w for i, w in enumerate(base)) for k in range(size)]
    words = [f"chain{i}" for i in range(400)]
    rows += [" ".join(words[4 * k : 4 * k + 100]) for k in range(75)]
    texts = list(dict.fromkeys(rows))
    s = {t: brute.shingles(t) for t in texts}
    near = {(a, b) for a in texts for b in texts if a < b and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])}
    got = pairs(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    of = groups(got, texts)
    assert got <= near and len(near) > len(texts)
    assert not [p for p in near if of[p[0]] != of[p[1]]] and of == groups(near, texts)


def test_common_shingles_only_change_the_order(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SAMPLE", 1)
    passage = " ".join(f"common{i}" for i in range(60))
    rows = [(k, passage + " " + " ".join(f"own{k // 2}x{j}" for j in range(20)) + f" end{k}") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s = {t: brute.shingles(t) for _, t in rows}
    near = {(a, b) for a in s for b in s if a < b and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])}
    assert len(jaccard.common(docs.selectExpr("xxhash64(text) h", "text"))) == 56
    assert pairs(docs) == near and len(near) == 6


def test_empty_documents(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert cp.run(spark, d).count() == 0
