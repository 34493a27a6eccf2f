import itertools
import random

import numpy as np
import pytest
import xxhash

from sitescore.llm import common
from sitescore.llm import simhash_anchors as sa
from sitescore.llm.common import connected_components


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "a b c d É é   x\ty", "the the the the the", "a b c " * 40_000])
def test_fingerprint(text):
    assert sa.fingerprint(text) & (1 << 64) - 1 == brute_fingerprint(text)


def test_fingerprint_is_the_same_in_chunks(monkeypatch):
    text = " ".join(str(i * i) for i in range(1000))
    whole = sa.fingerprint(text)
    monkeypatch.setattr(sa, "CHUNK", 7)
    assert sa.fingerprint(text) == whole


@pytest.mark.parametrize("length,poly,radius", {*sa.BLOCKS})
def test_codes_cover(length, poly, radius):
    """Every word has one codeword within the radius, and its table every codeword within radius + 2."""
    high, ends, differences = sa.coset_table(length, poly, radius, 2)
    r = poly.bit_length() - 1
    assert (ends[:, 1] - ends[:, 0] == 1).all()
    syndrome = lambda x: high[x >> r] ^ (x & ((1 << r) - 1))
    code = np.array([x for x in range(1 << length) if syndrome(x) == 0]) if length < 20 else np.flatnonzero(syndrome(np.arange(1 << length)) == 0)
    assert len(code) == 1 << (length - r)
    for x in random.Random(1).sample(range(1 << length), 20):
        s = syndrome(x)
        got = {int(x ^ d) for d in differences[ends[s, 0] : ends[s, 3]]}
        assert got == {int(c) for c in code[np.bitwise_count(code ^ x) <= radius + 2]}


@pytest.mark.parametrize("blocks", [2, 3])
def test_close_fingerprints_share_a_home(blocks):
    rng = random.Random(2)
    for n in (0, 1, 2):
        for _ in range(60):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), n):
                y ^= 1 << b
            pair = np.array([x, y], np.uint64).view(np.int64)
            home = sa.anchors(pair[:1], 0, blocks)[1]
            assert len(home) == 1 and home[0] in sa.anchors(pair[1:], 2, blocks)[1]


def brute_components(n, edges):
    at = list(range(n))
    for _ in range(n):
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    return at


@pytest.mark.parametrize("third_block_from", [1, 1 << 24])
def test_links_and_components(spark, third_block_from):
    rng = random.Random(5)
    fps = []
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps.append(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 2, 3])))
    fps = list(dict.fromkeys(fps))
    want = {(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2}
    df = spark.createDataFrame([(np.uint64(x).astype(np.int64).item(), i) for i, x in enumerate(fps)], "fp long, node long")
    links = sa.links(df, 2, third_block_from)
    got = [tuple(sorted(r)) for r in links.collect()]
    assert sorted(got) == sorted(want)
    roots = {r["a"]: r["root"] for r in connected_components(links).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == brute_components(len(fps), want)


@pytest.mark.parametrize("third_block_from", [1, 1 << 24])
def test_candidates_of_the_anchors(spark, third_block_from):
    """At each anchor what reaches it meets the smallest and the largest node at home there, up to 12 bits apart."""
    rng = random.Random(6)
    fps = []
    for _ in range(12):
        x = rng.getrandbits(64)
        fps += [x ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 0, 1, 3, 6, 9]))) for _ in range(rng.randint(2, 30))]
    rng.shuffle(fps)
    node, want, home, reach = {}, set(), {}, {}
    for i, x in enumerate(fps):
        want |= {(node.setdefault(x, i), i)}
    for x, i in node.items():
        one, blocks = np.array([x], np.uint64).view(np.int64), 3 if third_block_from == 1 else 2
        home.setdefault(sa.anchors(one, 0, blocks)[1][0], []).append((i, x))
        for a in sa.anchors(one, 2, blocks)[1]:
            reach.setdefault(a, []).append((i, x))
    want |= {(min(i, j), max(i, j)) for a, at in home.items() for j, y in (min(at), max(at)) for i, x in reach[a] if (x ^ y).bit_count() <= 12}
    want = {(i, j) for i, j in want if i != j}
    df = spark.createDataFrame([(np.uint64(x).astype(np.int64).item(), i) for i, x in enumerate(fps)], "fp long, node long")
    assert sorted(map(tuple, sa.candidates(df, third_block_from=third_block_from).collect())) == sorted(want)
    assert any((fps[i] ^ fps[j]).bit_count() > 2 for i, j in want)


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(500, 900)] + [(7, 7), (3, 4), (3, 4)]
    got = {r["a"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 5 for i in range(500, 900)} | {4: 3}


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    more = [(10_000 + i, rows[i % 5][1] + " extra" * (i % 3)) for i in range(60)]
    rows += more
    found = sa.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    edges = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 2]
    at = brute_components(len(rows), edges)
    smallest = {a: min(rows[i][0] for i in range(len(rows)) if at[i] == a) for a in {*at}}
    assert {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in found} == {rows[i][0]: (fps[i], smallest[at[i]]) for i in range(len(rows))}


def test_keep_one(edge):
    kept = sorted(str(r["doc_id"]) for r in sa.keep_one(edge).collect())
    found = sa.near_duplicates(edge).collect()
    want = sorted({str(r["component_id"]) for r in found if r["doc_id"] is not None} | {"None"}) + ["None"]
    assert kept == sorted(want)


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    cuts, plain = [], common.checkpoint
    monkeypatch.setattr(common, "checkpoint", lambda df: cuts.append(1) or plain(df))
    stars = [(10 * i + j, 10 * i) for i in range(20) for j in range(1, 9)]
    df = spark.createDataFrame([*stars, *((b, a) for a, b in stars), (None, 1), (3, None), (7, 7)], "a long, b long")
    assert sorted(map(tuple, connected_components(df).collect())) == stars
    assert len(cuts) == 1


@pytest.mark.parametrize("seed", range(3))
def test_stars_joined_by_links_of_their_roots(spark, seed):
    """Random edges, and links between the roots that these have and nodes of no edge: the same as all of them at once."""
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    root = brute_components(400, edges)
    links = [(root[rng.randrange(400)], root[rng.randrange(400)]) for _ in range(60)]
    df = lambda x: spark.createDataFrame(x, "a long, b long")
    got = [tuple(r) for r in common.joined_stars(connected_components(df(edges)), df(links)).collect()]
    want = brute_components(400, edges + links)
    assert sorted(got) == [(i, r) for i, r in enumerate(want) if i != r]
    known = connected_components(df(edges))
    assert sorted(map(tuple, common.joined_stars(known, df([])).collect())) == sorted(map(tuple, known.collect()))
