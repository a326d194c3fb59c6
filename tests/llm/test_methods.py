"""The methods' own pieces against plain versions, and queries without SQL against brute force on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from codeatlas.llm import huffman
from codeatlas.llm import suffix_dedup as suffixes
from codeatlas.llm.common import documents, rank_in_group
from codeatlas.llm.components import components
from codeatlas.llm.licenses import BASE, compile_template
from codeatlas.llm.packing import fullest, plan
from codeatlas.llm.queries import QUERIES
from codeatlas.llm.simhash import Forest, links
from codeatlas.llm.tokens import WordEncoder, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return sorted((r.doc_id, r.text or "") for r in documents(spark, SF).select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode_batch([t for _, t in texts], add_special_tokens=False)]


def test_word_encoder_is_the_library():
    random.seed(4)
    coder = WordEncoder()
    letters = "aZé.,'s!%&$*#<|>́é  ̸=tllvΣ1²ªʰɐİ\n\x1c"
    odd = ["", " ", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>.", "it's x'stop", "́.,", "日本語。 x"]
    odd += ["".join(random.choice(letters) for _ in range(random.randint(1, 30))) for _ in range(3000)]
    got, n = coder.encode(pa.array(odd).slice(0))
    at = 0
    for t, k in zip(odd, n, strict=True):
        assert got[at:at + k].tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids, t
        at += k


def test_fullest_is_the_best_subset():
    random.seed(1)
    for _ in range(200):
        counts = Counter(random.randint(1, 12) for _ in range(random.randint(0, 6)))
        room = random.randint(0, 30)
        best = max((s for s in _sums(list(counts.elements())) if s <= room), default=0)
        use = fullest(dict(counts), room)
        assert sum(k * m for k, m in use.items()) == best and all(counts[k] >= m for k, m in use.items())


def _sums(items):
    out = {0}
    for x in items:
        out |= {s + x for s in out}
    return out


def test_plan_places_every_piece_once():
    random.seed(2)
    counts = Counter(min(64, 1 + int(random.expovariate(0.05))) for _ in range(2000))
    rows = plan(dict(counts), 64)
    placed, bins = Counter(), defaultdict(list)
    for length, _, n, per, sequence, offset in rows.tolist():
        placed[length] += n
        for r in range(n):
            bins[sequence + r // per].append((offset + r % per * length, length))
    assert placed == counts
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(k * n for k, n in counts.items()) // 64) + 1


def test_huffman_round_trip_and_limit():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 1023, 1024, 1025, 30_000):
        ids = np.minimum(rng.zipf(1.2, n), 60_000)
        lengths = huffman.code_lengths(np.bincount(ids, minlength=1 << 16))
        data, offsets = huffman.encode(ids, huffman.codes(lengths), lengths)
        assert lengths.max(initial=0) <= huffman.LIMIT and len(offsets) == -(-n // huffman.BLOCK)
        assert (huffman.decode(data, offsets, n, huffman.decoding_table(lengths)) == ids).all()
    steep = huffman.code_lengths(np.array([2 ** min(k, 60) for k in range(40)]), limit=16)
    assert steep.max() == 16 and sum(2.0 ** -int(x) for x in steep) <= 1


def test_difference_cover():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


def test_forest_finds_all_neighbours():
    rng = np.random.default_rng(0)
    fps = set()
    for b in rng.integers(0, 1 << 63, 20).tolist():
        for _ in range(30):
            x = b
            for k in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(k)
            fps.add(x)
    fp = np.array(sorted(fps), dtype=np.uint64)
    shard = np.arange(len(fp)) // 100
    a, b = Forest(fp, shard).search(np.arange(len(fp)), 2)
    near = (np.bitwise_count(fp[:, None] ^ fp[None]) <= 2) & (shard[:, None] == shard[None]) & ~np.eye(len(fp), dtype=bool)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True))


def _roots(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for i, j in pairs:
        i, j = find(i), find(j)
        p[max(i, j)] = min(i, j)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("shard", [512, 8])
def test_links_lose_no_pair(spark, shard):
    rng = np.random.default_rng(5)
    fps = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in rng.integers(0, 1 << 62, 6) for i in range(0, 64, 5) for j in range(3, 64, 7)}
    fp = np.array(sorted(fps), dtype=np.uint64)
    number = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    got = links(spark.createDataFrame([(x,) for x in number], "fp long"), 2, shard).collect()
    near = np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= 2, 1)
    assert _roots(len(fp), [(number[r.a], number[r.b]) for r in got]) == _roots(len(fp), zip(*np.nonzero(near), strict=True))


def test_components_of_chains_and_stars(spark):
    random.seed(3)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(200, 300)] + [(k, k) for k in range(5)] + [(random.randint(400, 500), random.randint(400, 500)) for _ in range(60)]
    random.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _roots(501, edges)
    groups, other = defaultdict(set), defaultdict(set)
    for k, r in got.items():
        groups[r].add(k)
        other[want[k]].add(k)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in other.values()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_chain(spark, monkeypatch):
    """Ids in order along 10,000 edges: the rounds stay logarithmic."""
    from codeatlas.llm import components as module

    rounds, whole = [], module._priority
    monkeypatch.setattr(module, "_priority", lambda node, turn: rounds.append(turn) or whole(node, turn))
    got = components(spark.range(10_000).selectExpr("id as a", "id + 1 as b"))
    assert got.select("root").distinct().count() == 1 and got.count() == 10_001
    assert max(rounds) <= 14  # log2 of the nodes
    rounds.clear()
    star = components(spark.range(5_000).selectExpr("7000L as a", "id as b").union(spark.range(3).selectExpr("id + 9000 as a", "id + 9001 as b")))
    assert sorted(r["count"] for r in star.groupBy("root").count().collect()) == [4, 5001] and max(rounds) <= 2


def test_rank_in_group_splits_hot_groups(spark):
    rows = [(k, "hot" if k % 3 else None) for k in range(20_000)] + [(None, "hot"), (7, "hot")]
    got = rank_in_group(spark.createDataFrame(rows, "id long, g string").repartition(7), ["g"], "id", [], "rank").collect()
    for g in ("hot", None):
        own = sorted((r.rank, r.id if r.id is not None else -1) for r in got if r.g == g)
        assert [r for r, _ in own] == list(range(len(own))) and [i for _, i in own] == sorted(i for _, i in own)


def test_template_markup():
    a = compile_template("t", "licensed <<beginOptional>>to <<var;1..2>><<endOptional>> under the <<var;0..1>> license")
    at = lambda s: a.length_at(s.encode().split(), 0)
    assert at("licensed under the license") == 4 and at("licensed under the big license") == 5
    assert at("licensed to my friend under the license more") == 7
    assert at("licensed to under the license") == 0 and at("licensed under the very big license") == 0 and at("licensed under license") == 0
    with pytest.raises(ValueError):
        compile_template("t", "<<beginOptional>>a<<endOptional>>")


def _as_pattern(template):
    """A template as a regular expression over words that are each followed by a space."""
    word = lambda x: "".join(re.escape(w) + " " for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower()))
    out, at = "", 0
    for m in re.finditer(r"<<(beginOptional|endOptional|var;(\d+)\.\.(\d+))>>", template):
        out += word(template[at:m.start()])
        out += {"beginOptional": "(?:", "endOptional": ")?"}.get(m[1]) or rf"(?:\S+ ){{{m[2]},{m[3]}}}"
        at = m.end()
    return re.compile("(?:^|(?<= ))" + out + word(template[at:]))


def _filled(template, keep_optional):
    """A text that a template accepts."""
    text = re.sub(r"<<beginOptional>>((?:(?!<<beginOptional>>|<<endOptional>>).)*)<<endOptional>>", lambda m: m[1] if keep_optional else " ", template)
    text = re.sub(r"<<beginOptional>>((?:(?!<<beginOptional>>|<<endOptional>>).)*)<<endOptional>>", lambda m: m[1] if keep_optional else " ", text)
    return re.sub(r"<<var;(\d+)\.\.(\d+)>>", lambda m: " ".join(f"Some{k}" for k in range(max(1, int(m[1])))), text)


def test_license_labels_against_patterns(spark):
    """Whole licences, with and without their optional words, and the same with one mandatory word changed."""
    from codeatlas.llm.licenses import scan
    from codeatlas.llm.license_texts import TEMPLATES

    random.seed(6)
    docs = []
    for label, template in TEMPLATES.items():
        for keep in (False, True):
            text = f"Intro words here. {_filled(template, keep)}\n\nThe end."
            docs.append((label, True, text))
            w = text.split()
            for _ in range(2):
                k = random.randrange(3, len(w) - 2)
                docs.append((label, None, " ".join([*w[:k], "changed", *w[k + 1:]])))
            docs.append((label, None, " ".join(w[:len(w) // 2])))
    patterns = {label: _as_pattern(t) for label, t in TEMPLATES.items()} | {label: _as_pattern(t) for t, label in BASE.items()}
    got = {r.doc_id: r for r in scan(spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(docs)], "doc_id long, text string")).collect()}
    for k, (label, whole, text) in enumerate(docs):
        words_ = "".join(w + " " for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()))
        want = {name for name, p in patterns.items() if p.search(words_)}
        assert got[k].labels == ",".join(sorted(want)), (label, text)
        assert got[k].score == (1.0 if want - set(BASE.values()) else 0.6 if want else 0.0)
        assert not whole or label in want
    assert sum(docs[k][0] not in got[k].labels.split(",") for k in got if docs[k][1] is None) > len(docs) / 3


def test_licenses_against_brute_force(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op6_license_scan"](spark, SF).collect()}
    for k, t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        at = [(i, label) for i in range(len(w)) for phrase, label in BASE.items() if w[i:i + len(phrase.split())] == phrase.split()]
        r = got[k]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({label for _, label in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))


def test_token_files_against_the_library(spark, texts, ids):
    got = {r.doc_id: r for r in QUERIES["op9_token_files"](spark, SF).collect()}
    at = 0
    for (k, _), own in zip(texts, ids, strict=True):
        own = [*own, 2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)


def test_packing_against_the_library(spark, texts, ids):
    got = defaultdict(list)
    rows = QUERIES["op2_best_fit_packing"](spark, SF).collect()
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for (k, _), own in zip(texts, ids, strict=True):
        own = np.array([*own, 0], "<u4")
        assert sorted(got[k]) == [(n, a, len(own[a:a + 2048]), zlib.crc32(own[a:a + 2048].tobytes())) for n, a in enumerate(range(0, len(own), 2048))]
    assert len({r.sequence_id for r in rows}) <= 1.02 * -(-sum(r.length for r in rows) // 2048)


def test_simhash_against_brute_force(spark, texts):
    from xxhash import xxh64_intdigest

    def fingerprint(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        h = [xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = [fingerprint(t) for _, t in texts]
    a = np.array(fp, dtype=np.uint64)
    roots = _roots(len(fp), zip(*np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None]) <= 2, 1)), strict=True))
    got = {r.doc_id: r for r in QUERIES["op8_simhash_dedup"](spark, SF).collect()}
    for n, (k, _) in enumerate(texts):
        assert (got[k].fingerprint, got[k].component_id) == (f"{fp[n]:016x}", texts[roots[n]][0])


def brute_suffixes(rows):
    least = {}
    for k, t in rows:
        b = t.encode()
        for i in range(len(b) - 49):
            least[b[i:i + 50]] = min(k, least.get(b[i:i + 50], k))
    for k, t in rows:
        b, off = t.encode(), bytearray(len(t.encode()))
        for i in range(len(b) - 49):
            if least[b[i:i + 50]] < k:
                off[i:i + 50] = b"\1" * 50
        kept = bytes(c for c, x in zip(b, off, strict=True) if not x)
        yield k, (len(b), sum(off), sum(x and not y for x, y in zip(off, b"\0" + off, strict=False)), hashlib.sha256(kept).hexdigest())


_strong_names = suffixes.names_of_suffixes


def _weak_names(data, at):
    name, more = _strong_names(data, at)
    return name >> np.uint64(56) << np.uint64(56), more


def test_suffix_dedup_of_repeated_and_null_ids(spark, monkeypatch):
    """A row loses what a smaller id holds, and nothing to a row with its own id or, being without one, to another such."""
    random.seed(8)
    base = [" ".join(f"w{random.randint(0, 99)}" for _ in range(40)) for _ in range(6)]
    rows = [(5, "AAA" + base[0]), (5, "BBB" + base[0] + "x"), (None, "C" + base[1]), (None, "D" + base[1]), (None, base[0] + base[2]), (9, base[2] + "z"), (9, base[2] + "z"),
            (None, base[2] + "z"), (1, base[3]), (1, base[3] + base[4]), (2, base[3] + "q" + base[4]), (None, None), (3, None)]
    monkeypatch.setattr(suffixes, "LEAST_BLOCK", 1 << 8)
    got = [tuple(r)[:3] for r in suffixes.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    big = 1 << 60
    least = {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            least[b[i:i + 50]] = min(big if k is None else k, least.get(b[i:i + 50], big))
    want = []
    for k, t in rows:
        b, off = (t or "").encode(), set()
        for i in range(len(b) - 49):
            if least[b[i:i + 50]] < (big if k is None else k):
                off.update(range(i, i + 50))
        want.append((k, len(b), len(off)))
    assert Counter(got) == Counter(want)


def test_packed_ids():
    rng = np.random.default_rng(2)
    for n, most in ((0, 5), (1, 5), (1000, 10), (200_000, 1 << 62)):
        ids = rng.integers(0, most, n)
        assert (suffixes.unpacked_ids(suffixes.packed_ids(ids)) == ids).all()


def test_suffix_dedup_in_many_blocks(spark, monkeypatch):
    random.seed(3)
    base = ["".join(random.choice("abcdé \n") for _ in range(random.randint(1, 300))) for _ in range(12)]

    def cutting(s):
        return s[random.randint(0, len(s) // 2):][:random.randint(1, 200)]

    rows = [(k * 7 % 300, "".join(cutting(random.choice(base)) + "xyz "[:random.randint(0, 4)] for _ in range(random.randint(0, 5)))) for k in range(300)]
    rows += [(900, "a" * 3000), (901, "a" * 49), (902, "b" + "a" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(suffixes, "LEAST_BLOCK", 1 << 11)
    monkeypatch.setattr(suffixes, "names_of_suffixes", _weak_names)  # names that often agree in 64 bits
    got = {r.doc_id: tuple(r)[1:5] for r in suffixes.suffix_dedup(df, with_text=True).collect()}
    assert got == dict(brute_suffixes(rows))


@pytest.mark.parametrize("query, label", [("op4_quality_ranker", "quality"), ("op5_toxicity_chain", "toxic")])
def test_held_out_accuracy(spark, query, label):
    from codeatlas.llm.common import labels

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES[query](spark, sf).collect()}
    rows = [(got[r.doc_id], r[label]) for r in labels(spark, sf).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r, _ in rows)
    tested = [(r.predicted, y) for r, y in rows if r.held_out]
    assert sum(p == y for p, y in tested) / len(tested) > 0.93


def plain_bradley_terry(good, bad, seed=7):
    """The same pairs, one at a time."""
    from codeatlas.llm import quality_ranker as q

    rng = np.random.default_rng(seed)
    n = max(len(good), len(bad)) * q.PAIRS_EACH
    pairs = list(zip((rng.permutation(n) % len(good)).tolist(), (rng.permutation(n) % len(bad)).tolist(), strict=True))
    w, momentum = np.zeros(good.shape[1]), np.zeros(good.shape[1])
    for _ in range(q.ROUNDS):
        slope = np.zeros(len(w))
        for a, b in pairs:
            apart = good[a] - bad[b]
            slope -= apart / (1 + np.exp(w @ apart))  # of log(1 + exp(-w (a - b)))
        momentum = 0.9 * momentum - 0.3 * (slope / n + q.RIDGE * w)
        w = w + momentum
    return w


def test_pairwise_fit_against_a_plain_one():
    from codeatlas.llm.quality_ranker import fit_bradley_terry

    rng = np.random.default_rng(3)
    good, bad = rng.normal(0.4, 1, (12, 4)), rng.normal(-0.4, 1, (7, 4))
    assert np.allclose(fit_bradley_terry(good, bad), plain_bradley_terry(good, bad))


def test_quality_ranker_against_brute_force(spark, texts):
    from codeatlas.llm import quality_ranker as q
    from codeatlas.llm.common import labels

    marks, body = defaultdict(list), dict(texts)
    for r in labels(spark, SF).collect():
        if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            marks[r.doc_id].append(r.quality)
    rows = sorted((round(sum(v) / len(v)), k, q.features(body[k]).astype(float)) for k, v in marks.items() if k in body)  # fewer than a class may have
    x, y = np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    w = q.fit_bradley_terry(((x - mean) / spread)[y == 1], ((x - mean) / spread)[y == 0])
    score = (x - mean) / spread @ w
    best = max(((score[y == 0] <= t).mean() - (score[y == 1] <= t).mean(), -n) for n, t in enumerate(sorted(score)[:-1]))
    ranked = sorted(score)
    threshold = (ranked[-best[1]] + ranked[-best[1] + 1]) / 2
    got = {r.doc_id: r for r in QUERIES["op4_quality_ranker"](spark, SF).collect()}
    for k, t in texts:
        s = (q.features(t).astype(float) - mean) / spread @ w
        assert got[k].score == pytest.approx(1 / (1 + np.exp(np.clip(-(s - threshold) / (score.std() / 4 + 1e-9), -500, 500))), abs=1e-6)
        assert got[k].predicted == int(got[k].score >= 0.5) and got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)


def test_quality_ranker_fits_every_labelled_row(spark):
    """Blocks of 20 rows a class: means, weights and threshold are those of all rows, not of 20."""
    from codeatlas.llm import quality_ranker as q

    random.seed(11)
    words = ["tree", "river", "stone", "wind", "bridge", "lamp", "field", "cloud"]
    ids = [k for k in range(900) if zlib.crc32(str(k).encode()) % 3 != 1][:400]
    rows = [(k, " ".join(random.choice(words) + ("# $" if random.random() < (0.3 if n % 4 else 0.5) else "") for _ in range(random.randint(5, 40)))) for n, k in enumerate(ids)]
    rows += rows[:3] * 30  # repeated rows spread over the blocks
    y = {k: int(n % 4 != 0) for n, k in enumerate(ids)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(y.items()), "doc_id long, quality int")
    got = q.classify(docs, labels, "quality", 20).collect()
    assert len(got) == len(rows)
    good, bad = (np.array([r.score for r in got if y[r.doc_id] == c]) for c in (1, 0))
    gains = [(bad < t).mean() - (good < t).mean() for t in [*good, *bad]]
    assert (bad < 0.5).mean() - (good < 0.5).mean() == pytest.approx(max(gains))  # the best threshold over all rows
    x = spark.createDataFrame([(k, bytearray(q.features(t).tobytes()), y[k]) for k, t in rows], "doc_id long, x binary, y int")
    sizes = {c: sum(y[k] == c for k, _ in rows) for c in (0, 1)}
    blocks = q.in_blocks(x, sizes, 20).collect()
    assert Counter(r.doc_id for r in blocks if r.y == 1) == Counter(k for k, _ in rows if y[k] == 1)
    assert {r.doc_id for r in blocks if r.y == 0} == {k for k in ids if y[k] == 0}
    of = defaultdict(lambda: ([], []))
    for r in sorted(blocks, key=lambda r: (r.doc_id, bytes(r.x))):
        of[r.block][r.y].append(np.frombuffer(r.x, dtype=np.float32).astype(float))
    assert all(len(a) and len(b) < 45 for a, b in of.values())
    seen = np.array([q.features(t) for _, t in rows], dtype=float)
    mean, spread = seen.mean(axis=0), seen.std(axis=0) + 1e-3
    fits = [(max(len(a), len(b)), q.fit_bradley_terry((np.array(b) - mean) / spread, (np.array(a) - mean) / spread)) for a, b in of.values()]
    w = sum(n * v for n, v in fits) / sum(n for n, _ in fits)
    assert np.allclose(q.fit(x, 20)["w"], w, atol=1e-6)


def test_toxic_texts_are_found_in_every_language(spark):
    from codeatlas.llm.common import labels

    sf = "/root/testdata/sf0.1"
    of = {r.doc_id: r.lang for r in documents(spark, sf).select("doc_id", "lang").collect()}
    got = {r.doc_id: r for r in QUERIES["op5_toxicity_chain"](spark, sf).select("doc_id", "held_out", "predicted").collect()}
    tested = [(of[r.doc_id], got[r.doc_id].predicted, r.toxic) for r in labels(spark, sf).collect() if got[r.doc_id].held_out]
    found, toxic, called = Counter(), Counter(), Counter()
    for lang, p, t in tested:
        toxic[lang] += t
        called[lang] += p
        found[lang] += p and t
    print(found, toxic, called)
    assert sum(found.values()) >= 0.85 * sum(toxic.values()) and sum(found.values()) >= 0.95 * sum(called.values())
    for lang in toxic:
        assert found[lang] >= 0.6 * toxic[lang] and found[lang] >= 0.9 * called[lang], lang


def test_toxicity_categories_reach_every_language():
    from codeatlas.llm.toxicity import typical_groups

    rng = np.random.default_rng(5)
    present, langs, toxic = [], [], []
    for k in range(800):
        lang, bad = ("en", "de", "fr", "es")[k % 4], k % 20 < 4
        marks = {"en": [1, 2, 3], "de": [11, 12], "fr": [21, 22], "es": [31, 32]}[lang] if bad else []
        present.append(np.unique(np.append(rng.integers(100, 400, 30), marks)).astype(np.int32))
        langs.append(lang)
        toxic.append(float(bad))
    toxic, langs = np.array(toxic), np.array(langs)
    got = typical_groups(present, list(langs), toxic, 2)
    assert not got[toxic == 0].any()
    for lang in set(langs.tolist()):
        assert got[(langs == lang) & (toxic == 1)].all()
    assert typical_groups([], [], np.zeros(0), 2).shape == (0, 2)


def test_toxicity_labels_toxic_rows_of_every_language(spark, monkeypatch):
    from codeatlas.llm import toxicity
    from codeatlas.llm.common import labels

    sf, seen = "/root/testdata/sf0.1", {}
    whole = toxicity.typical_groups

    def watched(present, langs, toxic, n_groups):
        seen["langs"], seen["toxic"], seen["got"] = np.array(langs), toxic, whole(present, langs, toxic, n_groups)
        return seen["got"]

    monkeypatch.setattr(toxicity, "typical_groups", watched)
    toxicity.classify_toxic(documents(spark, sf), labels(spark, sf))
    for lang in ("en", "de", "fr", "es"):
        rows = seen["got"][(seen["langs"] == lang) & (seen["toxic"] == 1)]
        print(lang, len(rows), rows.sum(axis=0), rows.any(axis=1).sum())
        assert (rows.mean(axis=0) > 0.5).all()


# ---- operators 11 to 13 ---------------------------------------------------------------------------------------------

def brute_clusters(rows, k=8, rounds=10):
    import math

    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * x) for x in v]))
    kept.sort(key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in kept[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    whole = sum(d for _, d, _ in found)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, n, d, sum(e for _, e, m in found if m == n), whole, names[n]) for i, d, n in found)


def _vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


@pytest.mark.parametrize("block", [8192, 7])
def test_clusters_against_brute_force(spark, monkeypatch, block):
    from codeatlas.llm import centroids

    monkeypatch.setattr(centroids, "BLOCK", block)
    rng = np.random.default_rng(1)
    some = (rng.normal(0, 0.1, (60, 64)) + rng.integers(0, 3, (60, 1))).astype(np.float32).tolist()
    rows = [(k, v) for k, v in enumerate(some)] + [(3, some[5]), (3, some[5]), (None, some[6]), (None, some[7]), (90, None), (91, []), (92, some[0][:63]), (93, some[0] + [0.0]),
                                                   (94, [None, *some[0][1:]]), (95, [float("nan"), *some[0][1:]]), (96, [float("inf"), *some[0][1:]]), (97, [-1e5, *some[0][1:]])]
    got = centroids.cluster_report(_vectors(spark, rows).withColumns({"id": F.lit("clash"), "cluster": F.lit("clash")}).repartition(4)).collect()
    assert Counter(map(tuple, got)) == brute_clusters(rows)


def test_clusters_of_few_vectors(spark):
    from codeatlas.llm.centroids import cluster_report

    assert cluster_report(_vectors(spark, [])).count() == 0 and cluster_report(_vectors(spark, [(1, [0.5])])).count() == 0
    same = [(k, [0.25] * 64) for k in range(20)]  # equal vectors as centroids: ties go to the smaller number, the others stay empty
    assert {r.cluster for r in cluster_report(_vectors(spark, same, "double")).collect()} == {0}
    three = [(k, [float(k)] * 64) for k in range(3)]
    assert Counter(map(tuple, cluster_report(_vectors(spark, three, "double")).collect())) == brute_clusters(three)
    far = [(1, [1e30] * 64), (2, [1.0] * 64)]  # no long holds its distance
    assert [r.vec_id for r in cluster_report(_vectors(spark, far, "double")).collect()] == [2]


def test_lookup_tables_are_the_distances():
    from codeatlas.llm import centroids

    rng = np.random.default_rng(4)
    for most in (3, 1000, 1 << 27):
        x, c = rng.integers(-most, most, (500, 64)), rng.integers(-most, most, (5, 64))
        assert (centroids.distances(*centroids.encode(x), c) == ((x[:, None] - c[None]) ** 2).sum(axis=2)).all()


def brute_matches(docs, items, length=10, coverage=100):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = low(t)
        if w:
            m = max(1, min(length, -(-len(w) * coverage // 100), len(w)))
            for k in range(len(w) - m + 1):
                windows[tuple(w[k:k + m])].add("" if i is None else str(i))
    sizes, out = {len(w) for w in windows}, Counter()
    for i, t in docs:
        w, hit, found = low(t), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if tuple(w[k:k + m]) in windows:
                    found |= windows[tuple(w[k:k + m])]
                    hit.update(range(k, k + m))
        kept = " ".join(x for k, x in enumerate(w) if k not in hit)
        out[i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), kept] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"shard_words": 25}, {"length": 3, "coverage": 60}, {"length": 5, "coverage": 40, "shard_words": 30}])
def test_decontamination_against_brute_force(spark, monkeypatch, options):
    from codeatlas.llm import decontaminate

    monkeypatch.setattr(decontaminate, "PIECE", 16)
    monkeypatch.setattr(decontaminate, "SLICE", 500)
    random.seed(len(options))
    letters = ["a", "b", "c", "ab", "é", "wordlongerthaneight", "wordlongerthaneightandmore"]
    say = lambda more, n: " ".join(random.choice(letters + more) for _ in range(n))
    items = [(random.choice([None, 1, 2, 30, 4]), say([], random.randint(1, 14))) for _ in range(10)] + [(7, say(["x"], 300)), (8, None), (8, ""), (None, " - "), (1, "One"), (1, "One")]
    docs = [(k if k % 5 else None, say(["zz", "Ab", "one"], random.randint(0, 60))) for k in range(40)] + [(3, None), (3, ""), (4, "x"), (4, "x"), (50, say(["x"], 20_000)), (51, " ".join([items[0][1]] * 3))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"id": F.lit("clash"), "sha": F.lit("clash"), "items": F.lit("clash")}).repartition(3)
    got = decontaminate.matches(df, spark.createDataFrame(items, "item_id long, text string"), with_text=True, **options).collect()
    words_ = lambda t: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, words_(r.kept)) for r in got) == brute_matches(
        docs, items, options.get("length", 10), options.get("coverage", 100))


def test_decontamination_of_empty_tables(spark):
    from codeatlas.llm.decontaminate import contamination

    docs, none = spark.createDataFrame([(1, "Some words."), (2, None)], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert contamination(none, items).count() == 0
    assert {(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in contamination(docs, items.limit(0)).collect()} == {(1, 2, 0, False), (2, 0, 0, False)}
    assert {(r.doc_id, r.n_hit) for r in contamination(docs, items).collect()} == {(1, 2), (2, 0)}


def test_kernel_gives_shapley_values():
    from fractions import Fraction
    from itertools import permutations

    from codeatlas.llm.filter_audit import Kernel

    random.seed(9)
    for n in (2, 3, 5):
        value = [random.randint(0, 50) for _ in range(1 << n)]
        got = Kernel(n).solve(value)
        for i in range(n):
            total = 0
            for order in permutations(range(n)):
                before = sum(1 << j for j in order[:order.index(i)])
                total += value[before | 1 << i] - value[before]
            assert got[i] == Fraction(total, len(list(permutations(range(n)))))


def test_filter_audit_against_brute_force(spark):
    from itertools import permutations

    from codeatlas.llm.filter_audit import audit

    good = " ".join(f"w{k}" for k in range(60))
    rows = [(1, good, "s"), (2, good, "s"), (None, good, "s"), (None, good + " x", None), (3, None, None), (4, "", ""), (5, "a " * 80, "s"), (6, "AB cd#", "t"), (6, "AB cd#", "t"), (7, good.upper(), "t"),
            (8, good + " $", "s"), (9, " ".join(f"v{k}" for k in range(20_000)), "s")]
    marks = [(1, 1, 0), (2, 1, 1), (2, 0, None), (6, 0, 1), (None, 1, 1), (3, 1, None), (77, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"id": F.lit("clash"), "part": F.lit("clash"), "mask": F.lit(0), "sha": F.lit("clash"), "n": F.lit(1)}).repartition(3)
    labels_ = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("n", F.lit(5))
    least, out = {}, []
    for i, t, _ in rows:
        least[t or ""] = min((x for x in (least.get(t or ""), i) if x is not None), default=None)
    docs_ = []
    for i, t, s in rows:
        x, w = t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")
        fails = {"A"} if len(w) < 50 else set()
        fails |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in x) > 5 * len(x) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", x) else set()
        fails |= {"E"} if least[x] is not None and (i is None or i > least[x]) else set()
        docs_.append((s or "", fails, any(i is not None and m[0] == i and m[1] == 1 for m in marks), any(i is not None and m[0] == i and m[2] == 1 for m in marks)))
    for part in {d[0] for d in docs_}:
        own, shapley = [d for d in docs_ if d[0] == part], Counter()
        steps = []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [d for d in own if f in d[1] and not d[1] & set(order[:k])]
                shapley[f] += len(here)
                steps.append((order, k, f, sum(not d[1] & set(order[:k + 1]) for d in own), len(here), sum(f in d[1] for d in own) - len(here), sum(d[1] == {f} for d in own),
                              sum(d[2] for d in here), sum(d[3] for d in here)))
        out += [(part, "".join(o), k + 1, *rest, shapley[f]) for o, k, f, *rest in steps]
    got = [tuple(r)[:10] for r in audit(docs, labels_).collect()]
    assert Counter(got) == Counter(out)
    assert audit(docs.limit(0), labels_).count() == 0 and audit(docs, labels_.limit(0)).where("good_lost > 0").count() == 0
