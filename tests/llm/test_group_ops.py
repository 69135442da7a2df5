"""Operators that compare documents with each other, and the pipeline."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from smileforge.llm import ann, linededup, mixing, neardup, wordhash
from smileforge.llm.common import Workspace, fresh, table
from smileforge.llm.registry import ORACLE_SQL, QUERIES

from ..util import assert_same, connect
from .test_text_ops import EDGE, SCHEMA, edge, none  # noqa: F401


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], connect(sf_dir))


def test_ten_queries():
    assert sorted({n.split("_")[0] for n in QUERIES}) == sorted(f"op{k}" for k in range(1, 11))


# ---- line dedup ----


@pytest.mark.parametrize("bound", [linededup.BROADCAST_LINES, 0])
def test_lines(spark, monkeypatch, bound):
    monkeypatch.setattr(linededup, "BROADCAST_LINES", bound)
    rows = [(i, f"unique {i}\nshared\n\n", "a") for i in range(10)] + [(i, "shared\nother", "b") for i in range(10, 13)] + [(20 + i, "shared", None) for i in range(6)] + [(30, None, "a"), (31, "shared\nshared", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"host_": F.lit(1), "lines_": F.lit(2), "n_lines": F.lit("x")})
    out = {r["doc_id"]: r for r in linededup.drop_boilerplate(df).collect()}
    assert len(out) == len(rows)
    assert out[0]["text"] == "unique 0\n\n" and (out[0]["n_lines"], out[0]["n_dropped"]) == (4, 1)
    assert out[10]["text"] == "shared\nother"  # three pages say too little
    assert out[20]["text"] == "" and out[30]["text"] is None and out[30]["n_lines"] == 0 and out[31]["text"] == "" and out[31]["n_dropped"] == 2
    assert out[0]["host_"] == 1 and linededup.drop_boilerplate(df.where("false")).count() == 0


def test_lines_on_two_in_a_hundred_pages(spark):
    rows = [(i, f"unique {i}\nads" if i < 20 else f"unique {i}\ncommon" if i < 30 else f"unique {i}", "a") for i in range(1000)]
    out = {r["doc_id"]: r["text"] for r in linededup.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0] == "unique 0" and out[20] == "unique 20\ncommon"  # exactly 1 % is not above the ratio


def test_lines_of_minority_languages(spark):
    import corpus_pipeline as cp

    rows = [(i, f"unique {i}\nads\nmixed" if i < 100 else f"unique {i}\nrare", "en", "a") for i in range(1000)]
    rows += [(1000 + i, f"unique {1000 + i}\nannonces" if i < 10 else f"unique {1000 + i}", "fr", "a") for i in range(50)]
    rows += [(2000 + i, f"unique {2000 + i}\nanuncios" if i < 8 else f"unique {2000 + i}", None, "a") for i in range(40)]
    rows += [(3000 + i, f"unique {3000 + i}\nzu selten" if i < 4 else f"unique {3000 + i}", "de", "a") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    whole = {r["doc_id"]: r["text"] for r in linededup.drop_boilerplate(df).collect()}
    assert whole[0] == "unique 0" and whole[1000] == "unique 1000\nannonces"  # the ratio of all pages misses it
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cp.drop_boilerplate_lines(spark, df, "").collect()}
    assert len(got) == len(rows) and all(got[i][0] == f"unique {i}" for i in [*range(100), *range(1000, 1050), *range(2000, 2040)])
    assert got[100] == ("unique 100", 10) and got[3000][0] == "unique 3000\nzu selten"  # four pages say too little
    plain = cp.drop_boilerplate_lines(spark, df.drop("n_chars").withColumn("n_lines", F.lit("mine")), "")
    assert "n_chars" not in plain.columns and {r["n_lines"] for r in plain.collect()} == {"mine"}
    few = df.where("doc_id % 1000 in (0, 1) and doc_id < 3000").union(df.where("doc_id = 0")).withColumn("text", F.lit("shared"))
    assert {r["text"] for r in linededup.drop_boilerplate(few, part="lang").collect()} == {""}  # on five pages of several languages


def test_line_edges(edge):  # noqa: F811
    assert linededup.drop_boilerplate(edge).count() == len(EDGE)
    own = linededup.drop_boilerplate(edge.withColumn("n_lines", F.lit("mine")), counts=False)
    assert own.columns == [*edge.columns, "n_lines"] and {r["n_lines"] for r in own.collect()} == {"mine"}


# ---- mixing ----


def waterfill(totals, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(totals.values())
    while free:
        unit = left / sum(w[s] for s in free)
        over = [s for s in free if unit * w[s] > most * totals[s]]
        if not over:
            target |= {s: unit * w[s] for s in free}
            break
        for s in over:
            target[s] = most * totals[s]
            left -= target[s]
            free.discard(s)
    return target


def test_mix_comes_near(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(60), rng.choice(["a"] * 6 + ["b", "c", None, "ü"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and all(0 <= r["copies"] <= 2 for r in got)
    totals = collections.Counter()
    for _, t, s in rows:
        totals[s] += len(t.split())
    want = waterfill(totals)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == totals[r["source"]]
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}
    copies = collections.Counter(r["doc_id"] for r in mixing.apply_mix(df).collect())
    assert copies == collections.Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})


def test_many_sources(spark, monkeypatch):
    """Targets of many sources equal those of the plain list, whether the sources are broadcast or joined by salt."""
    rng = random.Random(11)
    totals = [(f"s{rng.randrange(10**9)}" if k else None, rng.randrange(200)) for k in range(3000)]
    space = Workspace(spark, "t")
    got = {(r["source"], r["n"]): r["target"] for r in mixing.target_table(space, spark.createDataFrame(totals, "source string, n long").repartition(5)).collect()}
    want = {(s, n): t for s, n, t in mixing.targets(totals)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert mixing.target_table(space, spark.createDataFrame([], "source string, n long")).count() == 0
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), None if i % 50 == 0 else f"h{i % 400 if i % 3 else 0}") for i in range(6000)], "doc_id long, text string, source string")
    small = {(r["doc_id"], r["target"], r["copies"]) for r in mixing.mix(docs).collect()}
    copies = collections.Counter(r["doc_id"] for r in mixing.apply_mix(docs).collect())
    monkeypatch.setattr("smileforge.llm.common.join_side.__defaults__", ("inner", 0))
    assert {(r["doc_id"], r["target"], r["copies"]) for r in mixing.mix(docs).collect()} == small and len(small) == 6000
    assert collections.Counter(r["doc_id"] for r in mixing.apply_mix(docs).collect()) == copies


def test_mix_edges(spark, edge, none):  # noqa: F811
    assert mixing.mix(edge).count() == len(EDGE) and mixing.apply_mix(edge).columns == edge.columns
    assert mixing.mix(none).count() == 0 and mixing.apply_mix(none).count() == 0
    same = spark.createDataFrame([(1, "a b", "s")] * 10 + [(2, "a", "t")], SCHEMA.replace("lang string, ", ""))
    assert len({r["copies"] for r in mixing.mix(same).where("doc_id = 1").collect()}) == 1
    empty = spark.createDataFrame([(1, "", "s"), (2, None, "s")], "doc_id long, text string, source string")
    assert {r["copies"] for r in mixing.mix(empty).collect()} == {0}
    assert mixing.targets([]) == []


# ---- near duplicates ----


def exact(rows, width, percent=80):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
        parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def exact_by_class(rows, width, percent=80):
    """As above for many rows: component ids by a matrix product."""
    words = [t.lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for w in words]
    number = {x: k for k, x in enumerate(set().union(*sets))}
    m = np.zeros((len(rows), len(number)), np.float32)
    for r, s in zip(m, sets):
        r[[number[x] for x in s]] = 1
    both, size = m @ m.T, m.sum(axis=1)
    near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    ids = np.array([i for i, _ in rows])
    label = ids.copy()
    while True:
        new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            return dict(zip(ids.tolist(), label.tolist()))
        label = new


def family(seed, copies, edits, length=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_exact(spark, width):
    texts = [t for s in range(12) for t in family(s, 12, 3)] + family(99, 60, 6) + ["short text", "Short  TEXT", "short", "", None, " \t"]
    rows = list(enumerate(texts))
    random.Random(3).shuffle(rows)
    want = exact(rows, width)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Tiny blocks, so that odd members are dealt over several."""
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 40)
    monkeypatch.setattr(neardup, "BLOCK_COLUMNS", 16)
    monkeypatch.setattr(neardup, "WORTHWHILE", 10.0)
    rows = list(enumerate(family(7, 150, 9)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == exact(rows, 4)


def test_near_duplicates_on_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    want = exact(rows, 4)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.op8_minmax_neardup(spark, sf_dir).collect()} == want


def test_near_duplicate_edges(edge, none):  # noqa: F811
    rows = neardup.near_duplicates(edge).collect()
    assert len(rows) == len(EDGE) and all(r["kept"] for r in rows)
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    left = neardup.drop_near_duplicates(edge)
    assert left.columns == edge.columns and left.count() == len(EDGE) - 1  # of the repeated row one stays
    assert neardup.near_duplicates(none).count() == 0 and neardup.drop_near_duplicates(none).count() == 0


def test_repeated_and_nameless_rows(spark):
    """Of each component one row stays: repeated rows, texts that share an id, and rows without one."""
    a, b = family(1, 1, 0)[0], family(2, 1, 0)[0]
    rows = [(5, a), (5, a), (5, b), (3, b), (None, a), (None, "no id"), (None, "no id"), (9, None), (9, None), (10, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["text"], r["component_id"]) for r in neardup.near_duplicates(df.withColumn("n_shingles", F.lit(0))).join(df.select("doc_id", "text").distinct(), "doc_id").collect())
    assert got[5, a, 5] == 2 and got[5, b, 3] == 1 and got[3, b, 3] == 1
    left = collections.Counter(map(tuple, neardup.drop_near_duplicates(df).collect()))
    assert left == collections.Counter([(5, a), (3, b), (None, "no id"), (9, None), (9, None), (10, "")])


def test_blocks_of_short_texts_are_bounded(spark):
    """Thousands of texts that share buckets and are no copies: blocks are bounded by documents too, and none is lost."""
    rng = random.Random(4)
    shared = [f"s{k}" for k in range(12)]
    rows = [(i, " ".join(shared + [f"u{i}a", f"u{i}b"])) for i in range(3000)] + [(5000 + i, " ".join(shared + [f"u{rng.randrange(3000)}a", "zz"])) for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    want = exact_by_class(rows, 4)
    assert got == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (12, 11), (3, 9), (20, 20)] + [(100, 100 + k) for k in range(1, 50)] + [(200 + k, 201 + k) for k in range(40)]
    got = {r["node"]: r["root"] for r in neardup.components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in (1, 2, 3, 9)) and got[12] == 10 and got[149] == 100 and got[240] == 200
    assert neardup.components(Workspace(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_minmax_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    same = (neardup.signature(a, 1024) == neardup.signature(b, 1024)).mean()
    assert abs(same - 800 / 1200) < 0.05


def test_shingles_do_not_cross_rows():
    import pyarrow as pa

    texts = ["a b c d e", "F g", None, "", "e f g h", "A B\tC\nd e"]
    sets = [s for _, data, off in wordhash.text_chunks(pa.array(texts), 8) for s in wordhash.shingle_sets(data, off, 4)]
    assert [len(s) for s in sets] == [2, 1, 0, 0, 1, 2] and (sets[0] == sets[5]).all()


# ---- neighbours ----


def test_forest_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = collections.defaultdict(list)
    for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 1500, 50):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        hits += len({v for v, _ in got[q]} & set(best))
        assert len(got[q]) == 20 and q not in dict(got[q])
        assert all(score == pytest.approx(x[v] @ x[q], abs=1e-9) for v, score in got[q])
        assert [v for v, _ in got[q]] == [v for v, _ in sorted(got[q], key=lambda t: (-t[1], t[0]))]
    assert hits / (30 * 20) >= 0.9


def test_forest_edges(spark):
    ok = [(20 * k, [1.0, 0.0]) for k in range(3)] + [(k, [1.0, 0.0]) for k in (1, 2, 3)]
    bad = [(100, None), (120, []), (140, [0.0, 0.0]), (160, [float("nan"), 1.0]), (180, [float("inf"), 1.0]), (200, [None, 1.0]), (None, [1.0, 0.0]), (220, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(ok + bad, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "block": F.lit(2), "dim": F.lit(3), "rank": F.lit(4)})
    got = collections.defaultdict(list)
    for r in ann.neighbours(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert dict(got) == {0: [1, 2, 3, 20, 40], 20: [0, 1, 2, 3, 40], 40: [0, 1, 2, 3, 20]}
    assert ann.neighbours(df.where("false")).count() == 0


def test_repeated_queries(spark):
    """A repeated query row is one query; rows of one id with other vectors are queries of their own."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [rows[0]] * 2 + [(20, [float(v) for v in x[7]])]
    got = collections.defaultdict(list)
    for r in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    assert len(got) == 20 and all(len(v) == (40 if q == 20 else 20) for q, v in got.items())
    assert sorted(k for k, _ in got[0]) == list(range(1, 21)) and len({v for _, v in got[0]}) == 20 and 0 not in {v for _, v in got[0]}
    assert sorted(k for k, _ in got[20]) == sorted([*range(1, 21)] * 2)


def test_many_equal_vectors(spark):
    rows = [(k, [0.6, 0.8, 0.0]) for k in range(300)] + [(1000 + k, [float(k), 1.0, 1.0]) for k in range(50)]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100, k=5).where("query_id = 100").orderBy("rank").collect()
    s = {i: np.dot(v, [0.6, 0.8, 0.0]) for i, v in rows if i != 100}
    assert [r["vec_id"] for r in got] == sorted(s, key=lambda i: (-round(s[i], 12), i))[:5]


# ---- helpers and pipeline ----


def test_fresh_names(edge):  # noqa: F811
    assert fresh(edge, "s_", "new", "NEW") == ["s__", "new", "NEW_"]


def test_disposable_tables_go(spark, tmp_path):
    import os

    from smileforge.llm.common import disposable

    kept = Workspace(spark, "kept")
    with disposable():
        gone = Workspace(spark, "gone")
        out = kept.write(gone.write(spark.range(5)))
        assert os.path.isdir(gone.root)
    assert not os.path.isdir(gone.root) and out.count() == 5


def test_pipeline_edges(spark, edge, none):  # noqa: F811
    """Null ids and texts, repeated rows, a very long text, clashing columns; and an empty table."""
    import corpus_pipeline as cp
    from smileforge.llm.common import disposable

    labels = spark.createDataFrame([(4, 1), (6, 0)], "doc_id long, toxic int")
    space = Workspace(spark, "edges")
    labels.write.mode("overwrite").parquet(f"{space.root}/labels.parquet")
    for docs, want in ((edge.withColumn("n_lines", F.lit("mine")), len(EDGE) - 1), (none, 0)):
        columns = docs.columns
        for name, stage in cp.STAGES:
            with disposable():
                docs = space.write(stage(spark, docs, space.root))
            if name == "minhash_neardup":
                assert docs.count() == want
            if name != "bpe":
                assert docs.columns == columns
        assert (docs.count() > 0) == bool(want)


def test_pipeline_equals_slow_version(spark, sf_dir):
    """Stage by stage, each against a plain version fed with the same rows."""
    import hashlib

    from tokenizers import Tokenizer

    import corpus_pipeline as cp
    from smileforge.llm import bpe, toxicity

    space = Workspace(spark, "pipe")
    docs = table(spark, sf_dir, "documents")
    names, stages = docs.columns, dict(cp.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "minhash_neardup", "source_mix", "bpe"]
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}

    a = space.write(stages["toxicity"](spark, docs, sf_dir))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    assert set(rows(a)) == {r["doc_id"] for r in docs.collect() if model.score(r["text"]) < toxicity.PREDICT_FROM}

    b = space.write(stages["line_dedup"](spark, a, sf_dir))
    pages, seen = collections.Counter(), collections.Counter()
    for r in a.collect():
        pages[r["source"]] += 1
        seen.update((r["source"], x) for x in set(r["text"].split("\n")) if x.strip())
    for i, r in rows(a).items():
        keep = [x for x in r["text"].split("\n") if not (seen[r["source"], x] >= 5 and seen[r["source"], x] > 0.08 * pages[r["source"]])]
        assert rows_b(b, space)[i] == ("\n".join(keep), len("\n".join(keep)))

    c = space.write(stages["minhash_neardup"](spark, b, sf_dir))
    want = exact([(i, r["text"]) for i, r in rows(b).items()], 5)
    assert set(rows(c)) == {i for i, (_, root) in want.items() if root == i}

    d = space.write(stages["source_mix"](spark, c, sf_dir))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(c).collect()}
    assert collections.Counter(r["doc_id"] for r in d.collect()) == collections.Counter({i: n for i, n in copies.items() if n})
    assert a.columns == b.columns == c.columns == d.columns == names

    lib = Tokenizer.from_file(bpe.vocabulary_path(bpe.VOCABULARY))
    lib.no_padding(), lib.no_truncation()
    texts = {i: r["text"] for i, r in rows(d).items()}
    final = stages["bpe"](spark, d, sf_dir).collect()
    for r in final:
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in cp.run(spark, sf_dir).collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in final)


_B: dict = {}


def rows_b(df, space):
    if space.root not in _B:
        _B[space.root] = {r["doc_id"]: (r["text"], r["n_chars"]) for r in df.collect()}
    return _B[space.root]
