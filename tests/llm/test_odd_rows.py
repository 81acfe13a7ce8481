"""Empty tables, repeated rows, ties, very long texts and clashing columns of the operators and the pipeline."""

import collections
import hashlib
import random

import pytest
from demandlens.llm import catalog, chat, exact_dedup, jaccard_join, packing, spelling, substring_dedup, suffix_dedup, toxicity, url_filter
from pyspark.sql import functions as F


def long_text(seed, n_words, letters="abcdefgh"):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))) for _ in range(n_words))


@pytest.fixture(scope="module")
def big(spark):
    """A document of more than a chunk, its copy with a changed word, a half of it, and small ones."""
    text = long_text(1, 1_600_000)
    words = text.split()
    words[5] = "changed"
    rows = [(1, text), (2, " ".join(words)), (3, " ".join(words[800_000:])), (4, "a b c"), (5, None)]
    assert len(text) > 6_000_000
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_substring_dedup_of_a_document_longer_than_a_chunk(big):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.cut_repeats(big).drop("kept", "spans").collect()}
    # Of the copy the words up to the changed one stay: every window over them holds it.
    assert got[1] == (1_600_000, 0) and got[3] == (800_000, 800_000)
    assert got[2] == (1_600_000, 1_600_000 - 6) and got[4] == (3, 0) and got[5] == (0, 0)


def test_suffix_dedup_of_a_document_longer_than_a_chunk(big):
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.cut_repeats(big).drop("kept").collect()}
    assert got[3][0] == got[3][1] and got[4] == (5, 0) and got[5] == (0, 0)
    for i in (1, 2):
        assert got[i][0] - got[i][1] < 60


def test_jaccard_join_of_a_document_longer_than_a_chunk(big):
    got = {r.doc_id: r.component_id for r in jaccard_join.similar(big).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_exact_dedup_and_packing_of_long_texts(big):
    kept = {r.doc_id for r in exact_dedup.drop_duplicates(big.unionByName(big)).collect()}
    assert kept == {1, 2, 3, 4, 5}
    pieces = packing.pack(big.filter("doc_id > 2"), catalog.vocabulary(), 2).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"))
    assert all(r.n == r["all"] for r in pieces.collect())


def test_buckets_hold_sequences_of_one_length(spark, tmp_path):
    docs = spark.createDataFrame([(i, long_text(i, 300 * i)) for i in range(12)], "doc_id long, text string")
    pieces = packing.pack(docs, catalog.vocabulary(), 2, 256)
    packing.write_buckets(pieces, str(tmp_path / "buckets"))
    folders = {int(p.name.split("=")[1]) for p in (tmp_path / "buckets").glob("length=*")}
    assert folders <= {1 << b for b in range(9)} and 256 in folders
    for length in folders:
        rows = spark.read.parquet(str(tmp_path / "buckets" / f"length={length}")).collect()
        assert rows and all(len(r.ids) == 4 * length for r in rows)
    assert spark.read.parquet(str(tmp_path / "buckets")).count() == pieces.count()


def test_a_run_of_letters_without_end(spark):
    """Words of a hundred thousand letters that differ in one of them."""
    rnd = random.Random(2)
    word = "".join(rnd.choice("abcdefghij") for _ in range(100_000))
    rows = [(i, w) for i, w in enumerate([word] * 8 + [word[:50_001] + "x" + word[50_002:]] * 3 + [word[:99_998] + word[99_999:]] * 3)]
    got = [(len(r.word), r.n >= 3, r.n_near, r.form is not None) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert collections.Counter(got) == {(100_000, True, 2, False): 1, (100_000, True, 1, True): 1, (99_999, True, 1, True): 1}


def test_url_filter_of_odd_rows(spark):
    names = "page_id long, url string, rule string, verdict string, host string, found string"
    long_url = "https://" + ".".join(["a"] * 20_000) + ".example.net/en/" + "x/" * 20_000
    rows = [(1, "http://net/", "r", "v", "h", "f")] * 3 + [(2, long_url, "r", "v", "h", "f"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, names)
    got = collections.Counter((r.page_id, r.rule, r.verdict) for r in url_filter.judge(df, catalog.URL_RULES, "page_id").collect())
    assert got == {(1, "net/", "block"): 3, (2, "example.net/en/", "allow"): 1, (None, None, "allow"): 1}
    assert url_filter.judge(df.limit(0), catalog.URL_RULES, "page_id").collect() == []


def test_chat_of_ties_repeats_and_long_texts(spark):
    text = "</s>[INST]\\" * 100_000
    rows = [(1, 0, "user", "b"), (1, 0, "assistant", "a"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "assistant", text), (2, 1, "assistant", None)]
    table = spark.createDataFrame([(*r, "x", 9) for r in rows], "conv_id long, turn long, role string, text string, formatted string, kept int")
    back = {r.conv_id: r for r in chat.read_back(chat.format_events(chat.as_events(table))).collect()}
    assert back[1].n_turns == 4 and back[2].n_turns == 2
    assert back[1].turns_sha256 == hashlib.sha256(b"assistant\na\nuser\na\nuser\na\nuser\nb\n").hexdigest()
    assert back[2].loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and back[2].loss_chars == len(text)


def test_toxicity_of_long_and_repeated_texts(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(200):
        toxic = i % 3 == 0
        rows.append((i, long_text(i, 60) + (" scum" if toxic else "")))
        labels.append((i, int(toxic)))
    plain = long_text(900, 400_000)
    assert len(plain) > toxicity.PART
    rows += [(900, plain), (901, plain + " scum"), (902, "so scum so"), (902, "so scum so")]
    docs = spark.createDataFrame([(*r, rnd.random(), "t") for r in rows], "doc_id long, text string, score double, toxic string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = collections.defaultdict(list)
    for r in toxicity.scores(docs, model).collect():
        scores[r.doc_id].append(r.score)
    assert len(scores[902]) == 2 and scores[902][0] == scores[902][1] > 0.5
    # A mark behind the first part of a long text counts as anywhere else.
    assert scores[901][0] > scores[900][0]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, shared ids and clashing columns come through every stage."""
    import corpus_pipeline

    clean = [(i, long_text(i, 80)) for i in range(30)]
    passage = "the quick brown fox jumps over the lazy dog and runs away from all the hounds"
    rows = [*clean, (40, None), (41, ""), (42, " \t"), clean[3], clean[3], (50, clean[4][1]), (51, clean[5][1] + " z"), (None, clean[6][1]), (None, None)]
    rows += [(7, "another text under an id that is taken " + long_text(70, 40)), (60, long_text(60, 30) + " " + passage + " " + long_text(61, 30))]
    names = "doc_id long, text string, lang string, source string, n_chars long, digest string, hot int, row int"
    docs = spark.createDataFrame([(*r, "en", "s", 1, "d", 2, 3) for r in rows], names)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(30)], "doc_id long, quality int, toxic int").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    step = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        step = function(spark, step, str(tmp_path))
        assert step.columns == docs.columns, name
    left = collections.Counter((r.doc_id, r.text) for r in step.collect())
    # One row a text (white space alone is one space); of the empty ones the smallest id; near copies and the benchmark's passage are gone.
    want = [*clean, (40, None), (42, " \t"), rows[-2]]
    assert left == collections.Counter(want)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r[0] for r in want}
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    for table in ("labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{table}.parquet")).limit(0).write.parquet(str(empty / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).collect() == []
