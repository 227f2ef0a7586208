import hashlib
import re

from pyspark.sql import functions as F

from sortilex.llm.decontaminate import _blocks, decontaminate, merge_ranges

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items, window=8):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found, patterns = set(), set(), {}
    for item_id, item in items:
        own = WORD.findall((item or "").translate(LOWER))
        n = min(window, len(own))
        for i in range(len(own) - n + 1) if n and item_id is not None else ():
            patterns.setdefault(tuple(own[i : i + n]), set()).add(str(item_id))
    for n in {len(p) for p in patterns}:
        for j in range(len(words) - n + 1):
            if (p := tuple(words[j : j + n])) in patterns:
                hit.update(range(j, j + n))
                found |= patterns[p]
    return len(words), len(hit), sorted(found)


ITEMS = [(1, "The cat sat on the mat and then it slept all day"), (2, "ÜBER straße 42"), (3, None), (4, "..."), (None, "never named"), (5, "sat on the mat and then it slept"), (1, "The cat sat on the mat and then it slept all day")]
TEXTS = ["x. The CAT, sat on the mat and then it slept; all day long", "sat on the mat and then it slept", "Über-Straße 42 über straße 42", "über straße 421", "sat on the mat and then it", None, "", "the cat sat on the mat and then it slept all day " * 50, "never named"]


def test_matches_brute_force(spark, docs, rows):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    more = [(1000 + i, t, None, None, None) for i, t in enumerate(TEXTS)]
    every = docs.unionByName(spark.createDataFrame(more, docs.schema))
    for options in ({}, {"block_bytes": 20}):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in decontaminate(every, bench, **options).collect())
        assert got == sorted((i is None, i or 0, *brute(t, ITEMS)) for i, t, *_ in [*rows, *more])


def test_spans_are_places_in_the_original(spark):
    text = "Zé — xx ÜBER,\n straße\t42! end"
    one = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = decontaminate(one, spark.createDataFrame(ITEMS, "item_id bigint, text string")).first()
    assert [text[s.start : s.end] for s in row.spans] == ["ÜBER,\n straße\t42"]
    assert [(h.first, h.last) for h in row.hits] == [(3, 5)]  # a dash outside ASCII is a word


def test_odd_tables(spark, docs, clashing, empty):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate(empty, bench).count() == 0
    assert all(r.n_items == 0 and r.n_hit == 0 for r in decontaminate(docs, none).collect())
    wide = decontaminate(clashing, bench.withColumnRenamed("item_id", "item_id"), tuple(clashing.columns))
    assert wide.count() == docs.count() and dict(wide.dtypes)["n_words"] == "bigint" and wide.columns.count("items") == 1
    assert merge_ranges([(3, 4), (0, 1), (2, 2), (9, 9)]) == [(0, 4), (9, 9)]


def test_query(spark, sf):
    from sortilex.llm.queries import op1_decontaminate

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in op1_decontaminate(spark, sf).collect():
        n, hit, found = brute(docs[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), len(found) >= 2)


def test_another_benchmark_in_the_same_workers(spark):
    """Workers keep an automaton between tasks; a second benchmark, of the same size and made in the same place, gets its own."""
    docs = spark.createDataFrame([(i, f"alpha{i} beta gamma delta epsilon zeta eta theta iota") for i in range(40)], "doc_id bigint, text string").repartition(4).cache()
    for k in (3, 8, 3):
        bench = spark.createDataFrame([(1, f"alpha{k} beta gamma delta epsilon zeta eta theta")], "item_id bigint, text string")
        assert [r.doc_id for r in decontaminate(docs, bench).where("n_items > 0").collect()] == [k]


def test_blocks_are_bounded_by_their_patterns(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{i * 7 + j}" for j in range(60))) for i in range(12)], "item_id bigint, text string")
    blocks = list(_blocks(items, 8, 1024))
    assert len(blocks) >= 4 and all(sum(map(len, b)) < 1024 + 100 for b in blocks)
    shared = spark.createDataFrame([(i, "one two three four five six seven eight") for i in range(3000)], "item_id bigint, text string")
    assert [len(ids) for _, ids in next(_blocks(shared.select(F.col("item_id").cast("string"), "text"), 8, 1 << 20)).values()] == [3000]
    docs = spark.createDataFrame([(0, "w8 w9 w10 w11 w12 w13 w14 w15 w16")], "doc_id bigint, text string")
    whole, cut = (decontaminate(docs, items, block_bytes=n).first() for n in (1 << 20, 1024))
    assert whole == cut and whole.n_items > 0
