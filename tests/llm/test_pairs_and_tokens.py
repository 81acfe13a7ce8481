"""Embedding links, spelling variants and token alignment against plain versions."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from demandlens.llm import embedding_dedup, spelling, token_alignment
from demandlens.session import stage
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<double>, label int, key string, rid int, shard string"


def vectors(seed=3, groups=(1, 1, 2, 3, 40, 160), n=500, size=16):
    """Random vectors, near copies around some middles, pairs near the limit, and rows that link with nothing."""
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        rows.append((rnd.normal(size=size), int(rnd.integers(0, 3))))
    for g, many in enumerate(groups):
        middle = rnd.normal(size=size)
        middle /= np.linalg.norm(middle)
        for _ in range(many):
            rows.append((7.5 * (middle + rnd.normal(size=size) * rnd.choice([0.02, 0.03, 0.045])), g % 2))
    rows += [(rows[0][0] * 2, rows[0][1]), (rows[1][0] * 1e-200, rows[1][1]), (rows[2][0] * 1e200, rows[2][1])]
    table = [(i, [float(x) for x in v], label, "k", 1, "s") for i, (v, label) in enumerate(rows)]
    i = len(table)
    odd = [None, [], [0.0] * size, [math.nan] * size, [math.inf] + [1.0] * (size - 1), [None] + [1.0] * (size - 1), [1.0, 2.0]]
    table += [(i + j, v, 0, None, None, None) for j, v in enumerate(odd)]
    table += [(i + 10, [1.0, 2.0], 0, "k", 1, "s"), (i + 11, table[3][1], None, "k", 1, "s"), (None, table[3][1], table[3][2], "k", 1, "s")]
    return table + [table[4], table[5], table[5]]


def plain_links(table, cosine):
    usable = [r for r in table if r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    unit = []
    for r in usable:
        v = np.array(r[1]) / max(map(abs, r[1]))
        unit.append(v / math.sqrt(float(v @ v)))
    near = [[j for j in range(len(usable)) if j != i and usable[j][2] == usable[i][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(len(usable))]
    at = {r[0]: r[0] for r in table}
    while True:
        low = dict(at)
        for i, some in enumerate(near):
            for j in some:
                low[usable[i][0]] = min(low[usable[i][0]], at[usable[j][0]])
        if low == at:
            break
        at = low
    counts = collections.defaultdict(list)
    for i, some in enumerate(near):
        counts[usable[i][0]].append(len(some))
    used = {id(r) for r in usable}
    for r in table:
        if id(r) not in used:
            counts[r[0]].append(0)
    return sorted(((i, n, at[i], i is not None and at[i] == i) for i, some in counts.items() for n in some), key=repr)


@pytest.mark.parametrize("cell,block,share", [(1_200, 4_000, 0.002), (40, 90, 0.002), (60, 100, 1.1), (10**6, 50, 1.1)])
def test_embedding_links(spark, monkeypatch, cell, block, share):
    """Whole shards, split shards, no tight groups, and blocks of shards that don't split."""
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "TIGHT_SHARE", share)
    table = vectors()
    df = spark.createDataFrame(table, VECTORS)
    got = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=repr)
    want = plain_links(table, 0.98)
    truth, found = sum(r[1] for r in want), sum(r[1] for r in got)
    assert len(got) == len(want) and truth > 10_000
    if share < 1 and cell > 1_000:
        assert got == want
    else:
        assert found >= 0.97 * truth
        assert all(g[0] == w[0] for g, w in zip(sorted(got, key=lambda r: repr(r[0])), sorted(want, key=lambda r: repr(r[0]))))
        most = collections.defaultdict(int)
        for i, n, _, _ in want:
            most[i] = max(most[i], n)
        assert all(n <= most[i] for i, n, _, _ in got)


def test_embedding_tables_without_links(spark):
    none = spark.createDataFrame([], VECTORS)
    assert embedding_dedup.near_duplicates(none).collect() == []
    one = spark.createDataFrame([(5, [1.0, 0.0], 1, None, None, None), (6, [0.0, 1.0], 1, None, None, None)], VECTORS)
    assert sorted(map(tuple, embedding_dedup.near_duplicates(one).collect())) == [(5, 0, 5, True), (6, 0, 6, True)]


def test_recall_is_measured(spark):
    """Half of the counts gone is half of the recall."""
    table = stage(embedding_dedup.labelled(spark.createDataFrame(vectors(n=50), VECTORS)), "vectors")
    counts, _ = embedding_dedup.linked(table)
    assert embedding_dedup.recall(table, counts) == pytest.approx(1.0, abs=0.02)
    halved = counts.select("rid", F.floor(F.col("n_links") / 2).alias("n_links"))
    assert embedding_dedup.recall(table, halved) == pytest.approx(0.5, abs=0.05)


def test_embedding_askers_are_dealt_to_bounded_parts(spark, monkeypatch):
    """A cell that many are compared with is held beside some of them at a time; the links stay the same."""
    monkeypatch.setattr(embedding_dedup, "CELL", 10**6)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 50)
    df = spark.createDataFrame(vectors(), VECTORS)
    sizes, search = [], embedding_dedup.search

    def sized(cells, cosine):
        sizes.append(cells.groupBy("cell").count().agg(F.max("count")).first()[0])
        return search(cells, cosine)

    monkeypatch.setattr(embedding_dedup, "search", sized)
    whole = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=repr)
    monkeypatch.setattr(embedding_dedup, "ASKED", 40, raising=False)
    parts = sorted(map(tuple, embedding_dedup.near_duplicates(df).collect()), key=repr)
    assert parts == whole and sum(r[1] for r in whole) > 10_000
    assert sizes[1] <= 150 < sizes[0]


def test_embedding_search_is_small_however_many_shards_overlap():
    """A cell whose rows are in many different shards needs no table of rows by sets of shards."""
    rnd = np.random.default_rng(8)
    n = 1_000
    x = rnd.normal(size=(n, 8))
    x[500:] = x[:500] + 0.01 * rnd.normal(size=(500, 8))
    vec = [v.tobytes() for v in x]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    lists = [[near[near >= 0].tobytes()] for near in embedding_dedup.Graph(unit).build().lists]
    shards = [["s", f"t{i % 500}"] for i in range(n)]
    cell = pa.table({"cell": ["s#0"] * n, "role": [0] * n, "rid": range(n), "rep": range(n), "vec": vec, "shard": ["s"] * n, "shards": shards, "lists": lists})

    class Cells:
        def groupBy(self, *keys):
            return self

        def applyInArrow(self, function, schema):
            return function

    run = embedding_dedup.search(Cells(), 0.98)
    tracemalloc.start()
    found = run(cell).to_pydict()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    truth = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    got = dict(zip(found["rid"], found["n"]))
    assert sum(got.values()) > 0.95 * truth.sum() and all(got.get(i, 0) <= truth[i] for i in range(n))
    assert most < 16e6, most


def test_graph_finds_tight_and_loose_groups():
    rnd = np.random.default_rng(5)
    middles = rnd.normal(size=(4, 24))
    middles /= np.linalg.norm(middles, axis=1)[:, None]
    x = np.concatenate([m + rnd.normal(size=(150, 24)) * s for m, s in zip(middles, (0.005, 0.01, 0.02, 0.03))] + [rnd.normal(size=(400, 24))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph = embedding_dedup.Graph(x).build()
    found = graph.within(x, 0.98)
    truth = x @ x.T >= 0.98
    assert not (found & ~truth).any()
    assert (found | found.T)[truth].mean() > 0.99


def spelled(seed=2, n=40):
    """Words of few letters, so that many are near, in documents with damage, accents, nulls and long runs."""
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abé") for _ in range(rnd.randint(4, 8))) for _ in range(150)]
    long = "abcdefghijklmnopqrstuvwxyz" * 3
    pool += [long, long[:40] + "q" + long[40:], long[:50] + long[51:], long[:11] + "z" + long[12:], "aaaaaaa", "aaaaaa", "aaaabaa"]
    pool += ["Grüße", "grüße", "GRüße", "Ünder", "ünder", "x×yzzz", "x÷yzzz"]
    rows = []
    for i in range(n):
        words = rnd.choices(pool, [(1, 3, 9, 27)[j % 4] for j in range(len(pool))], k=rnd.randint(0, 300))
        rows.append((i, rnd.choice([" ", ", ", "1", "\n"]).join(words)))
    rows += [(n, None), (n + 1, ""), (n + 2, "12 .. 3"), (n + 3, " ".join([long] * 500)), (None, "nulls nulls nulls"), rows[0], rows[0]]
    return rows


def plain_variants(rows, ratio=2):
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            if len(low) >= 5:
                counts[low] += 1
    counts = {w: n for w, n in counts.items() if n >= 3}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, out = {}, []
    for w in counts:
        some = [v for v in counts if near(w, v)]
        best = min(some, key=lambda v: (-counts[v], v), default=None)
        forms[w] = (best if best and counts[best] >= ratio * counts[w] else None, len(some))
    for w, (form, many) in forms.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out.append((w, counts[w], many, form, counts.get(form), root))
    return sorted(out, key=repr)


def test_spelling_variants(spark):
    rows = spelled()
    df = spark.createDataFrame([(*r, "w", 1, "f") for r in rows], "doc_id long, text string, word string, n int, form string")
    want = plain_variants(rows)
    assert len(want) > 50 and sum(r[3] is not None for r in want) > 20 and any(r[5] != r[3] for r in want if r[3])
    assert sorted(map(tuple, spelling.variants(df).collect()), key=repr) == want
    assert spelling.variants(df.limit(0)).collect() == []


def test_deep_nodes_are_verified(spark, monkeypatch):
    """With one letter a node and numbers that often agree, the words themselves decide."""
    monkeypatch.setattr(spelling, "SHALLOW", 1)
    plain = spelling.nodes
    monkeypatch.setattr(spelling, "nodes", lambda letters: [x if x >= 0 else -1 - (-x) % 5 for x in plain(letters)])
    rows = [r for r in spelled(7, 12) if len(r[1] or "") < 5_000]
    vocabulary = [(w, n) for w, n, *_ in plain_variants(rows)]
    numbered = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(sorted(vocabulary))], "id long, word string, n long")
    posted = []
    for i, (w, n) in enumerate(sorted(vocabulary)):
        letters = [spelling._letter(c) for c in w]
        ahead, back = spelling.nodes(letters), spelling.nodes(letters[::-1])[::-1]
        posted += [(ahead[k], back[k + 1], i, n, k, True, k == 0 or w[k] != w[k - 1]) for k in range(len(w))]
        posted += [(ahead[k], back[k], i, n, k, False, False) for k in range(len(w) + 1)]
    monkeypatch.setattr(spelling, "postings", lambda v: spark.createDataFrame(posted, spelling._POSTED))
    words = [w for w, _ in sorted(vocabulary)]
    got = {words[r.id]: r.n_near for r in spelling.neighbours(numbered).collect()}
    assert got == {r[0]: r[2] for r in plain_variants(rows) if r[2]}


def paths():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


TEXTS = [
    None, "", " ", "  ", "a", " a", "a b", "The  quick\tbrown\n\nfox", "naïve café 中文 🙂🙂 x", "<|endoftext|> <s> </s> <unk> <0x41>",
    "▁x y", "x▁", "tab\tand nbsp  em", "é ﬁ ½", "\x00 \x7f", "word " * 300, "a" * 3_000, "don't we'll I'D", "1234567 3.14159", "ends with space ",
]


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(paths()[0]), sentencepiece.SentencePieceProcessor(model_file=paths()[2])
    first.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}

    def bytes_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    docs, pairs = [], collections.Counter()
    for key, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a = [bytes(back[c] for c in first.id_to_token(i)) for i in a]
        parts_b = [bytes_b(i) for i in b]
        full = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != full or b"".join(parts_b) != full:
            docs.append((key, [], [], [], ""))
            continue
        span = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))]
        span_a, span_b = span(bytes_a), span(parts_b)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(span_a) for j, (t, f) in enumerate(span_b) if s < f and t < e]
        pairs.update(links)
        cuts = sorted({e for _, e in span_a} & {e for _, e in span_b})
        groups, at = [], 0
        for cut in cuts:
            left = ",".join(str(i) for i, (s, e) in zip(a, span_a) if at <= s and e <= cut)
            right = ",".join(str(i) for i, (s, e) in zip(b, span_b) if at <= s and e <= cut)
            groups.append(f"{left}|{right}")
            at = cut
        docs.append((key, a, b, links, ";".join(groups)))
    best = collections.Counter()
    for (_, b), n in pairs.items():
        best[b] = max(best[b], n)
    return sorted(
        (
            (key, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), groups, sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links))
            for key, a, b, links, groups in docs
        ),
        key=repr,
    )


def test_token_alignment(spark):
    rnd = random.Random(6)
    pool = [" ", "  ", "\n", "a", "the", "Straße", "été", "中", "🙂", "x́", "123", ".", "'s", "<s>", "​"]
    rows = list(enumerate(TEXTS)) + [(100 + i, "".join(rnd.choices(pool, k=rnd.randint(1, 60)))) for i in range(60)]
    rows += [(7, TEXTS[7]), (None, "no id"), (8, "other text of id 8")]
    df = spark.createDataFrame([(*r, 3, "p") for r in rows], "doc_id long, text string, slice int, pairs string").repartition(3)
    want = plain_alignment(rows)
    assert sum(r[1] > 0 for r in want) > 40 and sum(r[1] == 0 for r in want) > 3
    for size in (8_000_000, 300):
        got = token_alignment.counted(stage(token_alignment.align(df, *paths(), size), "aligned"))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    none = stage(token_alignment.align(df.limit(0), *paths()), "aligned")
    assert token_alignment.counted(none).collect() == []


def test_kept_windows_are_bounded():
    """Forgetting windows changes no result."""
    known = token_alignment.ByteVocabulary(*paths()[:2]), token_alignment.PieceVocabulary(paths()[2])
    texts = [(t or "").encode() for t in TEXTS]
    full, small = token_alignment.Aligner(*known), token_alignment.Aligner(*known, kept=0)
    for number in range(3):
        one, two = (list(a.slice(number, list(range(len(texts))), texts)) for a in (full, small))
        assert [r[:6] for r in one[:-1]] == [r[:6] for r in two[:-1]]
        assert np.array_equal(one[-1][3], two[-1][3]) and np.array_equal(one[-1][4], two[-1][4])


def test_windows_are_aligned_together():
    """A window is only numbered when it is met; all new ones are aligned at once, as each would be by itself."""
    rnd = random.Random(4)
    tokens = [b"", b"x", b"yy", b"zzz", b"wwwww"]
    known = token_alignment.Windows(*(token_alignment.TokenBytes(tokens) for _ in "ab"))

    def filled(size):
        ids = []
        while size:
            ids.append(rnd.choice([i for i in range(1, 5) if len(tokens[i]) <= size]))
            size -= len(tokens[ids[-1]])
        return ids

    windows = [(filled(n), filled(n)) for n in (rnd.randint(1, 12) for _ in range(300))]
    numbers = []
    for at, together in ((windows[:1], 5), (windows[:200], 7), (windows, 1_000)):
        numbers = [known[np.array([*a, token_alignment.MARK, *b], "<u4").tobytes()] for a, b in at]
        assert known.new
        known.learn(together)
        assert not known.new and len(known) == len(known.groups) == len(known.n_links)
    starts = np.cumsum(known.n_links) - known.n_links
    for (a, b), n in zip(windows, numbers):
        ends_a, ends_b = (np.cumsum([len(tokens[i]) for i in ids]).tolist() for ids in (a, b))
        both = sorted({*ends_a} | {*ends_b})
        pairs = [next(x for x, e in zip(a, ends_a) if e >= end) << 32 | next(y for y, e in zip(b, ends_b) if e >= end) for end in both]
        groups, at = [], 0
        for cut in sorted({*ends_a} & {*ends_b}):
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends) if at < e <= cut) for ids, ends in ((a, ends_a), (b, ends_b))))
            at = cut
        assert known.groups[n] == ";".join(groups)
        assert list(known.codes[starts[n] : starts[n] + known.n_links[n]]) == pairs


def test_query_digests_groups(spark, sf):
    from demandlens.llm import catalog

    rows = catalog.op13_token_alignment(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    some = [(i, docs[i]) for i in sorted(docs)[:5]]
    want = {r[0]: hashlib.sha256(r[5].encode()).hexdigest() if r[5] else "" for r in plain_alignment(some)}
    assert {r.doc_id: r.groups_sha256 for r in rows if r.doc_id in want} == want
