"""Quality scores, the prefix trie and vector codes against plain versions, on awkward rows and on whole tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import codes, quality, simhash, toxicity, trie
from ledgerloom.llm.queries import QUERIES, SQL

from ..test_queries import rows as plain_rows
from .test_operators import ROWS, docs, none, prose, values  # noqa: F401


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_vector_codes"])
def test_sql(name, spark, sf):
    duck = duckdb.connect()
    for table in ("conversations", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain_rows(got) == plain_rows(want)


# Quality


def plain_tokens(text: str) -> list[str]:
    return re.findall(rb"\n|[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0d\x20]+", text.encode())


def plain_shape(token: bytes):
    if not re.match(rb"[0-9A-Za-z\x80-\xff]", token):
        return token
    upper, digits = (len(re.findall(p, token)) for p in (rb"[A-Z]", rb"[0-9]"))
    case = 0 if not upper else 3 if upper == len(token) else 1 if upper == 1 and token[:1].isupper() else 2
    return case, 0 if not digits else 2 if digits == len(token) else 1, min(int(np.log2(len(token) + 1)), 7)


def plain_runs(text: str) -> Counter:
    """Runs of tokens and shapes with their numbers; features are these, hashed."""
    tokens = plain_tokens(text)
    lower, shapes = [t.lower() for t in tokens], [*map(plain_shape, tokens)]
    return Counter((kind, *of[i : i + n]) for kind, of, n in (("w", lower, 1), ("w", lower, 2), ("s", shapes, 1), ("s", shapes, 2), ("s", shapes, 3)) for i in range(len(of) - n + 1))


@pytest.mark.parametrize("text", ["", " ", "x", "The CAT's 3 cats, the cat!! \n\n *** | Äé mixED 12ab 1234", prose(3, 700), "\n" * 5, "a" * 3000])
def test_features_are_hashed_runs(text):
    """Without collisions, sorted counts of buckets are those of runs; two ways of one run have one bucket."""
    at, x = quality.features(text.encode())
    runs = plain_runs(text)
    total = sum(runs.values())
    assert np.all(np.diff(at) > 0) and abs(float((x.astype(float) ** 2).sum()) - (total > 0)) < 1e-4
    if total < 500:
        assert sorted(np.round(x.astype(float) ** 2 * total).astype(int)) == sorted(runs.values())


def test_a_text_in_steps_has_the_features_of_the_whole(monkeypatch):
    text = (prose(9, 4000) + "\n!! AB " + "q" * 900).encode()
    whole = quality.features(text)
    monkeypatch.setattr(quality, "STEP", 1000)
    for a, b in zip(whole, quality.features(text)):
        assert np.array_equal(a, b)


def plain_ftrl(rows, bias):
    """The updates one coordinate after the other."""
    z, n = defaultdict(float), defaultdict(float)

    def w(i):
        return 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(quality.ROUNDS):
        for text, y in rows:
            at, x = quality.features(text.encode())
            own = {i: w(i) for i in at.tolist()}
            p = 1 / (1 + np.exp(-(sum(own[i] * v for i, v in zip(at.tolist(), x.tolist())) + bias)))
            for i, v in zip(at.tolist(), x.tolist()):
                g = (p - y) * v
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA
                z[i], n[i] = z[i] + g - sigma * own[i], n[i] + g * g
    return {i: w(i) for i in z}


def test_training_is_follow_the_regularised_leader(spark):
    texts = [(i, prose(i, 30) + (" !!!" if i % 3 else "")) for i in range(12)]
    table = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(12)] + [(3, None), (None, 1), (5, 7)], "doc_id long, quality int")
    w, bias = quality.fit(table, labels)
    by_text = {t: int(i % 3 == 0) for i, t in texts}
    assert bias == pytest.approx(np.log(4.5 / 8.5))
    scores = {r["doc_id"]: r["score"] for r in quality.score(table, (w, bias)).collect()}
    # Any order of the rows gives about the same model; the plain version takes ids in order.
    want = plain_ftrl([(t, by_text[t]) for _, t in texts], bias)
    for i, t in texts:
        at, x = quality.features(t.encode())
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-(sum(want[k] * v for k, v in zip(at.tolist(), x.tolist())) + bias))), abs=0.05)


def test_quality_of_awkward_rows(spark, docs, none):  # noqa: F811
    labels = spark.createDataFrame([(0, 1), (1, 1), (4, 0), (4, 1), (6, 0), (None, 1), (8, None), (99, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    found = values(quality.score(docs, model))
    assert sorted(r[0] for r in found if r[0] is not None) == sorted(i for i, _ in ROWS if i is not None) and len(found) == len(ROWS)
    assert all(0 < r[1] < 1 for r in found)
    by_id = dict(found)
    assert by_id[2] == by_id[3] == pytest.approx(1 / (1 + np.exp(-model[1])))
    assert by_id[0] == by_id[1]
    assert values(quality.score(none, model)) == []
    assert {r[1] for r in values(quality.score(docs, quality.fit(docs, labels.limit(0))))} == {0.5}
    assert quality.fit(none, labels)[1] == 0.0


def test_quality_of_held_out_labels(spark):
    got = QUERIES["op11_quality"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    assert len(got) == 1000 and (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = got[got["held_out"]].merge(labels, on="doc_id")
    good, bad = (held[held["quality"] == y]["score"].to_numpy() for y in (1, 0))
    assert (good[:, None] > bad).mean() >= 0.95
    assert (good >= 0.5).mean() >= 0.97 and (bad < 0.5).mean() >= 0.7


# Prefix trie


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(own[c])] for c in own}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        rebuilt[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
        ends[rebuilt[c]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p in members
    )


def trie_rows(spark, rows):
    table = spark.createDataFrame([(*r, "k", 1, "i") for r in rows], "conv_id long, turn long, role string, text string, id string, depth int, parent string")
    return sorted(values(trie.prefix_trie(table.repartition(3))))


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_matches_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    monkeypatch.setattr(trie, "SEGMENT", 2)
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(0, 40), *range(95, 115), -100, -7, 300, 301, 10**12]:
        for t in range(int(rng.integers(1, 6))):
            rows.append((c, t, ["user", "bot"][t % 2], WORD(rng, 2)))
    rows += [(c, t, "user", f"t{t % 3}") for c in (7, 8, 9, 210, 211) for t in range(100, 175)]  # long, over many blocks
    rows += [(c, t, "user", f"s{t}") for c in range(500, 560) for t in range(9)]  # copies, one turn over a block
    rows += [(12, None, None, None), (12, None, None, ""), (12, 1, "a", "Äé€"), (12, 1, "a", "Äé€"), (12, 1, "", "a"), (None, 0, "user", "x"), (3, 0, "z", "tie"), (3, 0, "a", "tie")]
    rows.append((400, 0, "user", "w" * 100_000))
    rng.shuffle(rows := [tuple(r) for r in rows])
    assert trie_rows(spark, rows) == plain_trie(rows)


def WORD(rng, n):
    return ["yes", "no", "why?", ""][int(rng.integers(0, n + 2))]


def test_trie_of_turnless_and_no_conversations(spark):
    # 1 has one turn and h = 1 of an absent base: it is turnless.
    some = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 5)
    assert trie_rows(spark, [(some, 0, "u", "x")]) == [(some, 0, None, 1, 0, 1, 0, hashlib.sha256(str(some).encode()).hexdigest())]
    assert trie_rows(spark, []) == []


# Vector codes


def plain_codes(vectors, entries, rounds, parts):
    """Lloyd's rounds with all distances, in Python integers."""
    at = [i * len(vectors[0]) // parts for i in range(parts + 1)]
    cut = lambda v: [tuple(v[at[p] : at[p + 1]]) for p in range(parts)]
    books = [list(b) for b in zip(*map(cut, vectors[:entries]))]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for v in vectors:
                groups[nearest(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [tuple(sum(c) // len(groups[j]) for c in zip(*groups[j])) if j in groups else e for j, e in enumerate(books[p])]
    found = [[nearest(x, books[p]) for p, x in enumerate(cut(v))] for v in vectors]
    return [("".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f)) for f in found], ",".join(str(c) for b in books for e in b for c in e)


@pytest.mark.parametrize("length, spread", [(8, 3), (7, 300), (4, 60_000)])
def test_codes_match_brute_force(spark, length, spread, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 13)
    rng = np.random.default_rng(length)
    usable = [(i, [float(x) for x in rng.integers(-spread, spread, length) / (1024 if spread < 1000 else 1)], int(i % 3) if i % 4 else None) for i in range(-5, 70)]
    usable += [(200 + i, usable[i][1], 1) for i in range(10)] + [(3, usable[0][1], 1), (3, usable[1][1], 1), (None, usable[2][1], 2)]
    bad = [(4, None, 0), (5, [float("nan")] * length, 0), (6, [None] + [0.0] * (length - 1), 1), (7, [float("inf")] * length, 1), (8, [], 1), (9, [1.0] * (length + 1), 1), (10, [1e30] * length, 1)]
    table = spark.createDataFrame([(*r, "c", 1) for r in usable + bad], "vec_id long, embedding array<double>, label int, code string, error int").repartition(3)
    order = sorted(usable, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    found, books = plain_codes([[int(np.floor(1024 * x)) for x in r[1]] for r in order], 16, 4, 4)
    by_label = Counter()
    for r, (_, e) in zip(order, found):
        by_label[r[2]] += e
    want = [(r[0], c, e, by_label[r[2]], hashlib.sha256(books.encode()).hexdigest()) for r, (c, e) in zip(order, found)]
    assert sorted(values(codes.encode(table, 16)), key=repr) == sorted(want, key=repr)


def test_balls_measure_few_distances_and_win_as_a_full_search():
    rng = np.random.default_rng(5)
    entries = rng.integers(-500, 500, (64, 16))
    entries[9] = entries[4]  # equal entries: the lower index wins
    x = entries[rng.integers(0, 64, 3000)] + rng.integers(-90, 90, (3000, 16))
    full = codes.distances(x, entries)
    start = np.where(rng.random(3000) < 0.9, full.argmin(1), rng.integers(0, 64, 3000))
    at, best, measured = codes.ball_assign(x, entries, start)
    assert np.array_equal(at, full.argmin(1)) and np.array_equal(best, full.min(1))
    assert measured < full.size / 4


def test_codes_of_no_vectors(spark):
    table = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert values(codes.encode(table)) == [] and values(codes.encode(table.limit(0))) == []


# Near copies


def test_pairs_that_no_round_drew_are_compared(spark, monkeypatch):
    """Texts unlike each other that all meet, and one pair of near copies among them."""
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(64)]
    texts[41] = texts[23] + " end"
    # All meet on one variant; its first and last texts, which are compared first, are others.
    def met(prints):
        ends = prints.agg(F.min("node").alias("least"), F.max("node").alias("last"))
        return prints.select(F.lit(1).cast("long").alias("variant"), F.lit(0).alias("block"), "node").crossJoin(ends)

    monkeypatch.setattr(simhash, "meeting_texts", met)
    monkeypatch.setattr(simhash, "further_pairs", lambda met, alike, groups, tried, turn: tried.limit(0))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    kept = {r[0] for r in simhash.without_near_copies(table).select("doc_id").collect()}
    assert kept == set(range(64)) - {41}


def test_remaining_pairs_of_dealt_groups(spark):
    met = spark.createDataFrame([(v, n) for v in (1, 2) for n in range(30)] + [(3, 5), (3, 6)], "variant long, node long")
    groups = spark.createDataFrame([(n, n % 3) for n in range(29)], "node long, component long")
    tried = spark.createDataFrame([(0, 1), (5, 6)], "a long, b long")
    of = lambda n: n % 3 if n < 29 else n
    want = {(a, b) for a in range(30) for b in range(a + 1, 30) if of(a) != of(b)} - {(0, 1), (5, 6)}
    got = [tuple(r) for r in simhash.remaining_pairs(met, groups, tried, size=4).collect()]
    assert sorted(got) == sorted(want)


def test_toxicity_looks_a_word_up_once():
    looked = []

    class Words(dict):
        def get(self, key, default=None):
            looked.append(key)
            return super().get(key, default)

        def __contains__(self, key):
            looked.append(key)
            return super().__contains__(key)

        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    vectors = [{0: 1.0}, {1: 0.6, 2: 0.8}]
    model = toxicity.Model(Words({b"bad": 0, b"fine": 1, b"day": 2}), np.ones(3), 2.0, toxicity.BlockMax(vectors, [1, 0], [7, 8], 3), 0.5, 25, 2.0)
    score, evidence = model.score("A fine fine day, a FINE day.")
    assert sorted(looked) == [b"a", b"day", b"fine"]
    # Of the text's terms "a" is in no example and counts in the length alone.
    fine, day, a = 1 + np.log(3), 1 + np.log(2), 2 * (1 + np.log(2))
    assert evidence == [(8, round((0.6 * fine + 0.8 * day) / np.sqrt(fine**2 + day**2 + a**2), 9), 0)] and score < 0.5
