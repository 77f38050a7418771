"""Alignment of tokenizers, nearest neighbours and fill-in-middle against plain versions and on hard tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from siteline.llm import alignment, infill, vantage

ODD = ["", " ", "  ", "a ", " a", "a\n b", "x  y\t z \n", "<|endoftext|> <s> </s> <unk>", "a▁ b ok", "\0 x", "n b  sp", "é  x", "x\x1c y", "á ́b", "\U0001f600 \U0001f600\U0001f600", "<0x41> x", "1234 56 7", "it's don't 's 't", "<P> x <S> <M>", "a <S>", "\n\n  \n x", "Ｗｉｄｅ ﬁ", "wordwithoutend" * 700, "a b " * 60000]


@pytest.fixture(scope="module")
def table(spark, docs):
    """Documents with odd texts, repeated and null doc_ids, copies, and columns named like the operators' own."""
    some = docs.where("doc_id < 120 or doc_id > 100000").select("doc_id", "text")
    odd = spark.createDataFrame([(200_000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (7, "again"), (7, "again"), (8, None)], "doc_id long, text string")
    rows = some.unionByName(odd)
    for name in ("n", "form", "output", "block", "doc", "pair", "id", "of", "_text", "_cut", "dealt"):
        rows = rows.withColumn(name, F.lit("own"))
    return rows.cache()


# fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_infill(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = sha("42:" + ("" if doc_id is None else str(doc_id)))
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), form, len(prefix), len(middle), sha(out), sha(text)


def test_infill_is_the_plain_one(table):
    got = Counter(tuple(r) for r in infill.digest(infill.transform(table)).collect())
    assert got == Counter(plain_infill(r.doc_id, r.text) for r in table.collect())
    assert {k[2] for k in got} == {"plain", "psm", "spm"}


def test_infill_keeps_other_columns(table):
    out = infill.transform(table)
    assert set(out.columns) == set(table.columns) | {"n", "form", "prefix_chars", "middle_chars", "output"} and len(out.columns) == len(set(out.columns))
    assert {r.block for r in out.collect()} == {"own"} and out.count() == table.count()
    none = infill.digest(infill.transform(table.limit(0)))
    assert none.count() == 0


def test_infill_units(spark):
    rows = spark.createDataFrame([(i, "one two\nthree\n\nfour" * 3) for i in range(40)], "doc_id long, text string")
    for units, n in (("lines", 10), ("chars", 57), ("words", 10)):
        out = infill.transform(rows, fim_percent=100, units=units)
        assert {r.n for r in out.collect()} == {n}
        assert out.where(infill.restored(F.col("output"), F.col("form")) != F.col("text")).count() == 0
    assert {r.form for r in infill.transform(rows, fim_percent=0).collect()} == {"plain"}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3 * infill.SPAN), unique=True, max_size=300), st.booleans(), st.integers(0, infill.SPAN))
def test_boundary_set_selects(values, run, dense):
    if run:
        values = list(set(values) | set(range(dense, dense + 9000)))
    if dense % 3 == 0:
        values = list(set(values) | set(range(0, 2 * infill.SPAN, 2)))
    values = np.array(sorted(values), dtype=np.int64)
    chunks = [values[values // infill.SPAN == k] % infill.SPAN for k in range(5)]
    found = infill.BoundarySet(iter(chunks))
    assert len(found) == len(values)
    for k in {0, 1, len(values) // 2, len(values) - 1, *range(0, len(values), 997)} & set(range(len(values))):
        assert found.select(k) == values[k]


def test_containers():
    kinds = [infill.container(np.array(x)) for x in ([3, 5, 900], range(100, 60000), range(0, 60000, 2))]
    assert [type(k) for k in kinds] == [infill.Array, infill.Runs, infill.Bitmap]


@pytest.mark.parametrize("text", ["", "x", " ", "a b  c ", "ab " * 50000, "a" * (infill.SPAN - 1), "a" * infill.SPAN + " b", " " * (2 * infill.SPAN + 1), ("a" * (infill.SPAN - 2) + " ") * 3])
def test_boundaries_over_containers(text):
    found = infill.boundaries(text)
    ends = [m.end() for m in UNIT.finditer(text)]
    assert [found.select(k) for k in range(len(found))] == ends if len(ends) < 100 else [found.select(k) for k in range(0, len(found), 501)] == ends[::501]
    assert len(found) == len(ends)


# alignment of tokenizers


@pytest.fixture(scope="module")
def aligner():
    import public_tokenizers as P

    return alignment.Aligner(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def plain_tokens(aligner, text):
    if not text:
        return [], []
    a = aligner.a.own.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.own.encode(text)
    both = [[x.bytes_of[i] for i in ids] for x, ids in ((aligner.a, a), (aligner.b, b))]
    if any(b"".join(t) != (" " + text).encode() for t in both):
        return [], []
    ends = [np.cumsum([len(x) for x in t]).tolist() for t in both]
    return list(zip(a, [0, *ends[0]], ends[0])), list(zip(b, [0, *ends[1]], ends[1]))


def plain_align(aligner, rows):
    """By tokens' byte ranges alone, without pieces, memory or identity map."""
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b = plain_tokens(aligner, text)
        both = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, links, start, k = [], Counter(), 0, 0
        for i, s, e in a:
            while k < len(b) and b[k][2] <= s:
                k += 1
            n = k
            while n < len(b) and b[n][1] < e:
                links[i, b[n][0]] += 1
                n += 1
        for e in both if len(text or "") < 3000 else ():
            groups.append(",".join(str(i) for i, s, t in a if start <= s < e) + "|" + ",".join(str(i) for i, s, t in b if start <= s < e))
            start = e
        counts.update(links.keys())
        docs.append((doc_id, len(a), len(b), len(both), links, sha(";".join(groups)) if groups else None if both else ""))
    best = Counter()
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return Counter((d, na, nb, ng, sum(links.values()), sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), h) for d, na, nb, ng, links, h in docs)


def test_alignment_is_the_plain_one(table, aligner):
    got = alignment.align(table).collect()
    want = plain_align(aligner, [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])
    assert Counter(tuple(r)[:7] for r in got) == Counter(tuple(w)[:7] for w in want.elements())
    hashed = Counter(tuple(w) for w in want.elements() if w[7] is not None)
    assert not hashed - Counter(tuple(r) for r in got) and len(hashed) > 100
    assert alignment.align(table.limit(0)).count() == 0


def test_alignment_in_small_blocks_and_short_memory(spark, aligner, monkeypatch):
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()][:80] + ODD[:-2]
    whole = alignment.align_block(aligner, texts)
    monkeypatch.setattr(alignment, "MEMO", 50)
    monkeypatch.setattr(alignment, "RUN", 40)
    aligner.forget()
    for i in range(0, len(texts), 7):
        part = alignment.align_block(aligner, texts[i : i + 7])
        for c in whole[0]:
            assert list(part[0][c]) == list(whole[0][c][i : i + 7])
        for one, two in zip(part[1:], whole[1:]):
            own = (two[0] >= i) & (two[0] < i + 7)
            assert [x.tolist() for x in one] == [(two[0][own] - i).tolist(), two[1][own].tolist(), two[2][own].tolist()]
    aligner.forget()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab c\n\t'1é▁ \U0001f600<>|s .", max_size=30))
def test_pieces_are_safe(aligner, text):
    docs, _, _ = alignment.align_block(aligner, [text])
    a, b = plain_tokens(aligner, text)
    assert (docs["n_a"][0], docs["n_b"][0]) == (len(a), len(b))
    assert docs["n_groups"][0] == len({e for *_, e in a} & {e for *_, e in b})
    assert docs["n_links"][0] == len({e for *_, e in a} | {e for *_, e in b})


def test_identity_map(aligner):
    m = aligner.b_of_a
    assert all(aligner.b.bytes_of[j] == aligner.a.bytes_of[i] for i, j in enumerate(m) if j >= 0)
    ids = {t for t in aligner.b.bytes_of if t}
    assert all((j >= 0) == (aligner.a.bytes_of[i] in ids) for i, j in enumerate(m))


# nearest neighbours


def plain_nearest(rows, k=10, every=100):
    rows = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = Counter()
    for q in sorted({i for i, _ in rows if i % every == 0}):
        pairs = sorted((float(vantage.distances(c[None], v)[0]), j) for i, v in rows if i == q for j, c in rows if j != q and len(c) == len(v))
        out.update((q, n + 1, j, d) for n, (d, j) in enumerate(pairs[:k]))
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    rows = [(i, (base[i % 40] + 0.1 * rng.normal(size=8)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[5][1]) for i in range(700)]  # a large group of copies
    rows += [(100, rows[3][1]), (100, rows[100][1]), (200, rows[4][1]), (7, rows[7][1]), (7, rows[7][1]), (2100, [1.0, 2.0]), (2300, [1.0, 2.5]), (2301, [1.0, 2.5])]
    rows += [(None, rows[1][1]), (3000, None), (3100, []), (3200, [0.0] * 8), (3300, [1.0, None] + [0.0] * 6), (3400, [float("nan")] + [1.0] * 7), (3500, [float("inf")] + [1.0] * 7), (3600, [1e200] * 8)]
    return rows


@pytest.mark.parametrize("shard", [64, 5000])
def test_nearest_is_exact_at_factor_one(spark, vectors, shard):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("shard", F.lit("x")).repartition(3)
    got = Counter(tuple(r) for r in vantage.nearest(df, shard=shard, leaf=16).collect())
    assert got == plain_nearest(vectors)
    assert vantage.nearest(df.limit(0)).count() == 0


def test_relaxed_search(spark, vectors):
    rows = [x for x in vectors if x[0] is not None and x[0] < 1500]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = plain_nearest(rows)
    got = vantage.nearest(df, relax=2.0, leaf=8).collect()
    true = {(q, j): d for q, _, j, d in want}
    hits = sum((r.query_id, r.vec_id) in true for r in got)
    assert hits >= 0.9 * len(true) and all(true.get((r.query_id, r.vec_id), r.score) == r.score for r in got)
    with pytest.raises(ValueError):
        vantage.nearest(df, relax=0.5)


def test_tree_leaves_out_more_as_factor_grows():
    rng = np.random.default_rng(5)
    m = np.repeat(rng.normal(size=(64, 6)), 64, axis=0) + 0.05 * rng.normal(size=(4096, 6))
    tree = vantage.Tree.unpacked(vantage.Tree.build(np.arange(4096), m, leaf=16).packed())
    seen, found = {}, {}
    for relax in (1.0, 2.0, 20.0):
        each = [tree.search(int(tree.ids[i]), tree.m[i], 10, relax) for i in range(0, 4096, 64)]
        seen[relax], found[relax] = sum(x[2] for x in each) / 64, [set(x[0].tolist()) for x in each]
    assert seen[1.0] < 1400 and seen[2.0] < seen[1.0] and seen[20.0] <= seen[2.0]
    recall = sum(len(a & b) for a, b in zip(found[1.0], found[2.0])) / 640
    assert recall >= 0.9
    for i in range(0, 4096, 512):
        d = vantage.distances(tree.m, tree.m[i])
        d[i] = np.inf
        order = np.lexsort((tree.ids, d))[:10]
        assert tree.search(int(tree.ids[i]), tree.m[i], 10)[0].tolist() == tree.ids[order].tolist()


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert Counter(tuple(r) for r in vantage.nearest(df, shard=128).collect()) == plain_nearest(rows)
