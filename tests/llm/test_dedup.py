"""Operators 1, 7 and 8 against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from haplospark.llm import graph_components, simhash, substring_dedup, suffix_dedup
from tests.llm.conftest import DOCUMENT, document, prose


# --- substring dedup


def test_substring_dedup_against_brute_force(edges):
    got = substring_dedup.dedup(edges).collect()
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    gone = substring_dedup.brute_force(rows)
    assert len(got) == len(rows) and "fp" in got[0].asDict()
    left = {}
    for (i, t), out in gone.items():
        pieces = substring_dedup.sentences(t)
        left.setdefault(i, []).append((len(pieces), len(out), "".join(p for k, p in enumerate(pieces) if k not in out) if out else t))
    for r in got:
        assert (r["n_sentences"], r["n_removed"], r["text"]) in left[r["doc_id"]]
    assert any(r["n_removed"] for r in got)


def test_first_occurrence_stays(spark):
    passage = prose(50, 60)
    docs = spark.createDataFrame([document(k, prose(100 + k, 40) + "\n" + passage + "\n" + prose(200 + k, 40)) for k in range(6)], DOCUMENT)
    got = {r["doc_id"]: r for r in substring_dedup.dedup(docs).collect()}
    assert passage in got[0]["text"] and all(passage[:100] not in got[k]["text"] for k in range(1, 6))
    for k in range(1, 6):
        assert got[k]["text"].startswith(prose(100 + k, 40)) and got[k]["text"].endswith(prose(200 + k, 40))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 9), max_size=30))
def test_runs_are_shortest(sizes):
    pieces = ["w " * k + "." for k in sizes]
    words = [len(p.split()) for p in pieces]
    runs = substring_dedup.runs(pieces, 2, 7)
    good = lambda i, j: j - i + 1 >= 2 and sum(words[i : j + 1]) >= 7
    n = len(pieces)
    expected = set()
    for i in range(n):
        ends = [j for j in range(i, n) if good(i, j)]
        starts = [k for k in range(i + 1) if good(k, i)]
        expected |= ({(i, ends[0])} if ends else set()) | ({(starts[-1], i)} if starts else set())
    assert set(runs) == expected and len(runs) == len(set(runs))


def test_short_runs_go_without_a_floor(spark, tmp_path):
    from haplospark.llm import queries

    texts = ["Open daily. Ring twice.", "Open daily. Ring twice.", "Other words. Ring twice.", "A start. Open daily. Ring twice. An end."]
    spark.createDataFrame([document(k, t) for k, t in enumerate(texts)], DOCUMENT).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_removed"] for r in queries.queries()["substring_dedup_every_run"](spark, str(tmp_path)).collect()}
    assert got == {i: len(gone) for (i, _), gone in substring_dedup.brute_force(list(enumerate(texts)), words=0).items()} == {0: 0, 1: 2, 2: 0, 3: 2}


def test_substring_empty(nothing):
    assert substring_dedup.dedup(nothing).collect() == []


# --- suffix arrays


def removed(docs, **how):
    return suffix_dedup.remove(docs, ["doc_id"], **how).collect()


def expected(texts):
    out = []
    for t, gone in zip(texts, suffix_dedup.brute_force(texts), strict=True):
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def check(docs):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    want = sorted(((i is None, i or 0, *e) for (i, _), e in zip(rows, expected([t for _, t in rows]), strict=True)))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in removed(docs))
    assert got == want
    return got


def test_suffix_dedup_on_edges(edges):
    got = check(edges)
    assert any(g[3] for g in got)


def copies(spark):
    rng = random.Random(3)
    passages = [prose(700 + k, 70) for k in range(4)]
    texts = []
    for k in range(60):
        t = prose(300 + k, 60)
        for p in rng.sample(passages, rng.randint(0, 2)):
            cut = rng.randint(0, len(t))
            part = p[rng.randint(0, 60) : len(p) - rng.randint(0, 60)]
            t = t[:cut] + part + t[cut:]
        texts.append(t)
    texts += [texts[0], texts[1].replace("an", "xyz", 1), "ab" * 300, "ab" * 150, "é" * 100 + "a" * 250]
    return spark.createDataFrame([document(k, t) for k, t in enumerate(texts)], DOCUMENT)


def test_suffix_dedup_on_passages(spark):
    check(copies(spark))


def test_suffix_dedup_of_dealt_groups(spark, monkeypatch):
    """Anchors with more than three contexts are dealt to several tasks; texts are cut into small pieces."""
    monkeypatch.setattr(suffix_dedup, "MAX_GROUP", 3)
    check(copies(spark).repartition(5))


@pytest.mark.parametrize("piece", [64, 1000])
def test_runs_pick_equal_windows_alike(piece, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    passage = prose(1, 90).encode()
    texts = [prose(2, 50).encode() + passage + b"x" * 30, b"q" + passage]
    seen = {}
    for k, t in enumerate(texts):
        for body, begin, end, which, place in suffix_dedup._pieces([t]):
            own, a, b, p, _ = suffix_dedup.runs(np.frombuffer(body, np.uint8), begin, end)
            for o, i, j, at in zip(own, a, b, p, strict=True):
                shift = int(place[o] - begin[o])
                for w in range(i, j + 1):
                    assert (k, w + shift) not in seen
                    seen[k, w + shift] = int(at - w)
    assert set(seen) == {(k, i) for k, t in enumerate(texts) for i in range(len(t) - 199)}
    off = len(prose(2, 50).encode())
    assert all(seen[0, off + i] == seen[1, 1 + i] for i in range(len(passage) - 199))


@settings(deadline=None, max_examples=40)
@given(st.lists(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=9), min_size=1, max_size=5))
def test_suffix_sort(groups):
    texts = [t for g in groups for t in g]
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    start = np.cumsum([0, *map(len, texts)])[:-1]
    suffixes = suffix_dedup.Suffixes(np.frombuffer(b"".join(texts) + b"\0", np.uint8), start, np.array([len(t) for t in texts]))
    order, lcp = suffix_dedup.suffix_sort(group, suffixes)
    assert [texts[k] for k in order] == [t for g in groups for t in sorted(g)]
    for k in range(1, len(texts)):
        a, b = texts[order[k - 1]], texts[order[k]]
        common = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == (common if group[order[k - 1]] == group[order[k]] else -1)


def test_collisions_fall_back_to_bytes(monkeypatch):
    """With hashes that are all equal, the verification notices and sorts exactly."""
    monkeypatch.setattr(suffix_dedup.Suffixes, "_hash", lambda self, at, n: np.zeros(len(at), np.uint64))
    texts = [b"bca", b"abc", b"abd"]
    s = suffix_dedup.Suffixes(np.frombuffer(b"".join(texts), np.uint8), np.array([0, 3, 6]), np.array([3, 3, 3]))
    order, lcp = suffix_dedup.suffix_sort(np.zeros(3, np.int64), s)
    assert order.tolist() == [1, 2, 0] and lcp.tolist() == [-1, 2, 0]


def test_suffix_empty(nothing):
    assert removed(nothing) == []


# --- simhash


def test_fingerprint_words():
    for t in (None, "", "a b", prose(3, 90), "x " * 5000):
        assert int(simhash.fingerprint((t or "").encode())[0]) == slow_fingerprint(t)


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs):
    """pairs: (id, fingerprint) -> id -> least id reachable."""
    prints = sorted({f for _, f in pairs})
    root = {f: f for f in prints}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, f in enumerate(prints):
        for g in prints[:i]:
            if (f ^ g).bit_count() <= 4:
                root[max(find(f), find(g))] = min(find(f), find(g))
    least = {}
    for i, f in pairs:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [least.get(find(f)) for _, f in pairs]


def test_simhash_on_edges(edges):
    got = simhash.near_groups(edges).collect()
    rows = [(r["doc_id"], slow_fingerprint(r["text"])) for r in edges.collect()]
    want = sorted(((i is None, i or 0, f, -1 if c is None else c) for (i, f), c in zip(rows, slow_components(rows), strict=True)))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] % (1 << 64), -1 if r["component_id"] is None else r["component_id"]) for r in got) == want


@pytest.mark.parametrize("large, hot", [(4096, 200_000), (5, 200_000), (5, 12)])
def test_cover_finds_every_link(spark, large, hot, monkeypatch):
    """Fingerprints at distances around the threshold, in clusters and chains; also with anchors cut by pieces, within a task and over several."""
    monkeypatch.setattr(simhash, "LARGE", large)
    monkeypatch.setitem(simhash.HOT, 1, hot)
    rng = random.Random(5)
    flip = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(64), n))
    prints = []
    for _ in range(60):
        f = rng.getrandbits(64)
        for n in (0, 1, 2, 3, 4, 4, 5, 6):
            prints.append(f := flip(f, n) if rng.random() < 0.5 else flip(f, n))
    centre = rng.getrandbits(64)
    prints += [flip(centre, rng.randint(1, 3)) for _ in range(300)]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in set(prints)]
    links = simhash.links(spark.createDataFrame(signed, "f0 bigint"))
    assert links.count() <= 4 * len(signed) * 46 * (1 if hot > 12 else 6)
    roots = {r["node"] % (1 << 64): r["root"] for r in graph_components.components(links).collect()}
    own = [f % (1 << 64) for (f,) in signed]
    want = slow_components(list(enumerate(own)))
    groups = {}
    for f, c in zip(own, want, strict=True):
        groups.setdefault(c, []).append(f)
    for members in groups.values():
        assert len({roots.get(f, f) for f in members}) == 1 if len(members) > 1 else members[0] not in roots
    by_root = {}
    for f, c in zip(own, want, strict=True):
        if f in roots:
            by_root.setdefault(roots[f], set()).add(c)
    assert all(len(c) == 1 for c in by_root.values())


def test_cover_geometry():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 63, (200, 2), dtype=np.int64).astype(np.uint64)
    anchor, index, home = simhash.cover(fps)
    assert home.sum() == 6 * len(fps)
    for a, i in zip(anchor.tolist(), index.tolist(), strict=True):
        first, bits = simhash.BLOCKS[(a >> 22) % 3]
        assert ((int(fps[i, (a >> 22) // 3]) >> first & ((1 << bits) - 1)) ^ (a & ((1 << 22) - 1))).bit_count() <= 2
        assert simhash.SYNDROMES[a & 0x7FFF] == 0


@pytest.mark.parametrize("one_task", [100_000, 0])
def test_components(spark, one_task, monkeypatch):
    monkeypatch.setattr(graph_components, "ONE_TASK", one_task)
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(100)] + [(200, k) for k in range(201, 260)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in graph_components.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for u, v in links:
        if u is not None:
            root[max(find(u), find(v))] = min(find(u), find(v))
    assert got == {x: find(x) for x in root}
    named = spark.createDataFrame([(f"{u}".encode(), f"{v}".encode()) for u, v in links if u is not None], "u binary, v binary")
    least = {}
    for x in root:
        least[find(x)] = min(least.get(find(x), f"{x}"), f"{x}")
    assert {int(r["node"]): bytes(r["root"]).decode() for r in graph_components.components(named).collect()} == {x: least[find(x)] for x in root}
    assert graph_components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_near_dedup_keeps_one(edges, nothing):
    kept = simhash.near_dedup(edges, simhash.CONTRACT)
    assert kept.columns == edges.columns
    rows = [(r["doc_id"], slow_fingerprint(r["text"])) for r in kept.collect()]
    every = [(r["doc_id"], slow_fingerprint(r["text"])) for r in edges.collect()]
    assert len(rows) == len(set(f for _, f in rows)) and 0 in [i for i, _ in rows] and 1 not in [i for i, _ in rows]
    index = {f: k for k, f in enumerate(sorted({f for _, f in every}))}
    groups = slow_components([(index[f], f) for _, f in every])
    assert len(rows) == len(set(groups))
    assert simhash.near_dedup(nothing).count() == 0 and simhash.near_groups(nothing).count() == 0


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_copies_of_similarity(spark):
    """Copies with scattered words replaced: from a similarity of 0.85 on they go, nothing below 0.5 does."""
    rng = random.Random(8)
    docs, near, far = [], set(), set()
    for k in range(60):
        words = prose(500 + k, rng.choice([60, 150, 400])).split()
        docs.append(document(10 * k, " ".join(words)))
        for j, share in enumerate((0.01, 0.02, 0.03, 0.2), 1):
            other = [f"zz{rng.random()}" if rng.random() < share else w for w in words]
            docs.append(document(10 * k + j, " ".join(other)))
            likeness = jaccard(" ".join(words), " ".join(other))
            (near if likeness >= 0.85 else far if likeness < 0.5 else set()).add(10 * k + j)
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(docs, DOCUMENT)).collect()}
    assert {10 * k for k in range(60)} | far <= kept
    assert len(near & kept) <= 0.05 * len(near)


def slow_similar(rows, least=0.8):
    """doc_id -> least id of its group, over all pairs, by the similarity that near_dedup asks for; and all similarities."""
    sets = [simhash.shingle_hashes((t or "").encode(), simhash.SIMILAR).tobytes() for _, t in rows]
    alike = np.array([[simhash.jaccard(a, b) for b in sets] for a in sets])
    label = np.array([i for i, _ in rows])
    while True:
        new = np.array([label[alike[k] >= least].min() for k in range(len(rows))])
        if (new == label).all():
            return label, alike
        label = new


@pytest.mark.parametrize("blocks, dim", [(6, 5), (5, 6), (4, 8)])
def test_masks_cover(blocks, dim):
    """Of any dim - 1 bits of a block some mask has none; pairs of similarity 0.8 meet in each covering."""
    keep = simhash.masks(blocks, dim)
    assert len(keep) == blocks * ((1 << dim) - 1) and np.bitwise_count(keep).sum(axis=1).min() >= 16
    rng = random.Random(dim)
    differ = lambda bits: np.array([[sum(1 << b % 64 for b in bits if b // 64 == w) for w in range(3)]], np.uint64)
    for _ in range(100):
        block = rng.randrange(blocks)
        bits = rng.sample(range(192 * block // blocks, 192 * (block + 1) // blocks), dim - 1)
        others = [b for b in range(192) if not 192 * block // blocks <= b < 192 * (block + 1) // blocks]
        assert ((keep & differ(bits + others)) == 0).all(axis=1).any()
    met = [bool(((keep & differ(rng.sample(range(192), 29))) == 0).all(axis=1).any()) for _ in range(300)]
    assert sum(met) >= 0.98 * len(met)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(0, 5)), max_size=25))
def test_spanning_forest(links):
    links = [x for x in links if x[0] != x[1]]
    a, b, w = (np.array([x[k] for x in links], np.int64) for k in range(3))
    pick, root = simhash.spanning(8, a, b, w)
    assert (root == simhash.forest(8, a, b)).all() and len(pick) == 8 - len(set(root.tolist()))
    assert (simhash.forest(8, a[pick], b[pick]) == root).all()
    label, weight = list(range(8)), 0  # Kruskal
    for x, y, v in sorted(links, key=lambda x: x[2]):
        if label[x] != label[y]:
            weight, old = weight + v, label[x]
            label = [label[y] if k == old else k for k in label]
    assert w[pick].sum() == weight


def scattered(first, copies, seed, share):
    """Texts, each with several copies that have scattered words replaced."""
    rng, docs = random.Random(seed), []
    for k in range(first):
        words = prose(900 + 7 * seed + k, rng.choice([60, 150, 400])).split()
        docs.append(document(len(docs), " ".join(words)))
        for _ in range(copies):
            docs.append(document(len(docs), " ".join(f"zz{rng.random()}" if rng.random() < share else w for w in words)))
    return docs


@pytest.mark.parametrize("hot", [16_384, 6])
def test_near_dedup_against_all_pairs(spark, hot, monkeypatch):
    """Copies around the similarity asked for: what has 0.8 goes, what has less stays; also with anchors that are cut into parts."""
    monkeypatch.setitem(simhash.HOT, 3, hot)
    docs = scattered(50, 1, 1, 0.02) + [document(1000 + d[0], d[1]) for d in scattered(12, 6, 2, 0.03)]
    rows = [(d[0], d[1]) for d in docs]
    label, alike = slow_similar(rows)
    band = alike[np.triu_indices(len(rows), 1)]
    assert ((band >= 0.6) & (band < 0.8)).sum() > 40 and ((band >= 0.8) & (band < 0.95)).sum() > 40
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame(docs, DOCUMENT), how=simhash.SIMILAR).collect()}
    assert len(got) == len(rows)
    group = np.array([got[i] for i, _ in rows])
    joined, linked = group[:, None] == group[None, :], label[:, None] == label[None, :]
    assert not (joined & ~linked).any()  # nothing is joined that true links do not join
    for low, high, least in ((0.8, 0.85, 0.9), (0.85, 1.01, 0.97)):
        here = (alike >= low) & (alike < high) & ~np.eye(len(rows), dtype=bool)
        assert joined[here].mean() >= least
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(docs, DOCUMENT)).collect()}
    assert kept == set(group.tolist())


def test_left_out_links_are_searched_again(spark):
    """A chain: a's links within a forest fail, so that others, left out for it, decide."""
    words = [f"w{k}" for k in range(400)]
    # b, c and d lie 0.66 from each other and close to a; e is close to b alone
    texts = [" ".join(words[k] if (k * 7 + s) % 40 else f"x{s}{k}" for k in range(400)) for s in range(8)]
    texts += [t.replace("w399", "end") for t in texts]
    rows = list(enumerate(texts))
    label, alike = slow_similar(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame([document(*r) for r in rows], DOCUMENT), how=simhash.SIMILAR).collect()}
    assert [got[i] for i, _ in rows] == label.tolist() and 1 < len(set(label.tolist())) < len(rows)
    assert ((alike > 0.5) & (alike < 0.8)).any()


def test_left_out_nodes_take_one_row_each(spark, monkeypatch):
    """A family just below the similarity asked for shares many anchors: what is searched again holds each text once, and no link is lost by that."""
    seen = {}

    def stored(df, name, *done):
        out = real(df, name, *done)
        if name in ("out", "labelled", "again"):
            seen.setdefault(name, []).append(out.count())
        return out

    real = simhash.stored
    monkeypatch.setattr(simhash, "stored", stored)
    docs = scattered(3, 25, 6, 0.022)
    rows = [(d[0], d[1]) for d in docs]
    label, alike = slow_similar(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame(docs, DOCUMENT), how=simhash.SIMILAR).collect()}
    assert [got[i] for i, _ in rows] == label.tolist()
    assert ((alike > 0.6) & (alike < 0.8)).sum() > 400 and seen["again"][0] > 10
    assert max(n for sizes in seen.values() for n in sizes) <= len(rows)


def test_nodes_that_are_searched_again(spark):
    """Both ends of every link that an anchor left out are, if verified links don't join them."""
    rng = np.random.default_rng(3)
    links, failed, left, ends = [], [], [], set()
    for anchor in range(30):
        at = rng.choice(200, 25, replace=False)
        a, b = at[rng.integers(0, 25, 60)], at[rng.integers(0, 25, 60)]
        off = rng.integers(0, 40, 60).astype(np.uint8)
        fps = np.arange(200, dtype=np.uint64)[:, None]
        u, v, out = simhash.candidates(np.full(200, anchor), fps, np.arange(200), iter([(a, b, off)]), 1)
        chosen = set(zip(u.tolist(), v.tolist(), strict=True))
        left += [x for x in zip(a.tolist(), b.tolist(), strict=True) if x[0] != x[1] and x not in chosen]
        ends |= set(out.tolist())
        for x in sorted(chosen):
            (links if (x[0] * 31 + x[1] * 17) % 5 == 0 else failed).append(x)
    root = simhash.forest(200, *np.array(links).T)
    table = spark.createDataFrame([(k, r) for k, r in enumerate(root.tolist())], "node long, root long")
    opened = simhash._open(spark.createDataFrame([(x,) for x in ends], "fp long"), spark.createDataFrame(failed, "u long, v long"), table).collect()
    again = {r["fp"]: r["label"] for r in opened}
    apart = [(x, y) for x, y in left if root[x] != root[y]]
    assert len(again) == len(opened) and len(apart) > 100 and all(x in again and y in again and again[x] != again[y] for x, y in apart)
    none = simhash._open(spark.createDataFrame([(x,) for x in ends], "fp long"), spark.createDataFrame(links, "u long, v long"), table)
    assert none.isEmpty()


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    text = prose(31, 90)
    docs = [document(1, text)] * 3 + [document(1, text, "b"), document(2, text), document(3, prose(32, 90)), document(None, None), document(None, None), document(4, "")]
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in simhash.near_dedup(spark.createDataFrame(docs, DOCUMENT).repartition(4)).collect())
    assert kept == [(False, 1), (False, 3), (False, 4)]


def test_digest_is_of_the_kept_bytes(spark):
    from haplospark.llm import queries

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = list(texts)
    gone = suffix_dedup.brute_force([texts[i] for i in ids])
    got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in queries.op7_suffix_array_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (sum(g), hashlib.sha256(bytes(b for b, x in zip(texts[i], g, strict=True) if not x)).hexdigest()) for i, g in zip(ids, gone, strict=True)}
    assert any(n for n, _ in got.values()) and not all(n for n, _ in got.values())
