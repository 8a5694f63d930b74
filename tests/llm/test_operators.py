"""The operators against brute force, on whole small tables and on awkward ones."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from pactlake.llm import bottomk, cpsjoin, flac, gbdt, induced, mixing, queries, repeats, skipchain, token_counts, warc, word_shuffle_bpe
from tests.llm import brute

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, row long, part int, kind int, doc long, gram long, size long, key long, block long, component string, stats string"


def awkward_rows():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeghiknorst") for _ in range(rng.randint(2, 9)))
    prose = [" ".join(word() for _ in range(rng.randint(30, 200))) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(prose)]
    rows += [(100 + i, t) for i, t in enumerate(prose[:4])]  # copies
    rows += [(200 + i, t.replace(t.split()[3], "Changed", 1)) for i, t in enumerate(prose)]  # near copies
    rows += [
        (300, None), (301, ""), (302, " \t\n "), (303, "One two"), (304, "one TWO"), (305, "é" * 150),
        (306, "ab" * 400), (307, "x" * 30000), (308, "<|endoftext|> end <|endoftext|>")
    ]
    rows += [
        (309, "Call +1 (017) 555-7713 or a.b@c.example.org, 10.0.0.255; card 4539 1488 0343 6467."),
        (310, "\U0001f600 漢字 ԱՐ ՘ ½ ² 12345 's"), (311, prose[5] + " " + prose[6])
    ]
    rows += [(None, prose[1]), (None, None), (5, prose[5]), (5, prose[5])]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [(i, t, "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), *[k] * 8, *["x"] * 2) for k, (i, t) in enumerate(rows)]
    extra = [(*r[:5], 1, 1, 1, 1, 1, 1, 1, 1, 1, "c", "d") for r in extra]
    return spark.createDataFrame(extra, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def same(df, cols, want):
    assert sorted((tuple(r) for r in df.select(cols).collect()), key=repr) == sorted(want, key=repr)


def test_keep_one_of_clashing_ids(spark):
    """A shared doc_id drops no text that is unlike the others; copies go, also under another id."""
    rng = random.Random(11)
    text = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(4)]
    every = [
        (1, text[0]), (1, text[1]), (1, text[1] + " more"), (2, text[1]), (2, text[2]), (3, text[3]), (3, text[3]),
        (4, ""), (4, ""), (5, None), (None, text[0])
    ]
    got = [tuple(r) for r in cpsjoin.keep_one(spark.createDataFrame(every, "doc_id long, text string")).collect()]
    short = sorted((repr(i), next((k for k, t in enumerate(text) if s and s.startswith(t)), s)) for i, s in got if s not in ("", None))
    assert short == [("1", 0), ("1", 1), ("2", 2), ("3", 3), ("None", 0)]
    assert sorted((i, s) for i, s in got if s in ("", None)) == [(4, ""), (5, None)]


def test_near_duplicates(docs, rows, empty):
    same(cpsjoin.near_duplicates(docs), ["doc_id", "n_shingles", "component_id", "kept"], brute.near_duplicates(rows))
    assert cpsjoin.near_duplicates(empty).count() == 0
    one = cpsjoin.keep_one(docs)
    assert one.columns == docs.columns
    kept = {c for _, _, c, k in brute.near_duplicates(rows) if k and c is not None}
    assert sorted(r.doc_id for r in one.where("doc_id is not null").collect()) == sorted(kept)


def test_near_duplicates_in_chunks(docs, rows, monkeypatch):
    """Families dealt into chunks, and nodes that are branched, give the same components."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    big = [(1000 + k, " ".join(w if rng.random() > 0.02 else f"z{rng.randint(0, 9)}" for w in base)) for k in range(60)]
    spark = docs.sparkSession
    monkeypatch.setattr(cpsjoin, "CHUNK_SETS", 8)
    monkeypatch.setattr(cpsjoin, "LEAF", 4)
    same(
        cpsjoin.near_duplicates(spark.createDataFrame(big, "doc_id long, text string")),
        ["doc_id", "n_shingles", "component_id", "kept"], brute.near_duplicates(big)
    )


def test_flac(docs, rows, empty):
    want = []
    for i, t in rows:
        b = (t or "").encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        want.append((i, len(b), len(p), brute.sha(p), zlib.crc32(p[-16:])))
    media = flac.store(docs)
    same(flac.features(media), ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32"], want)
    for r in media.limit(5).collect():  # the general reader agrees, and blocks can be sought
        whole = (flac.decode_stream(bytes(r.media)) + 128).astype(np.uint8).tobytes()
        parts = flac.pcm_blocks(media.where(F.col("media") == r.media).limit(1)).orderBy("first_sample").collect()
        assert b"".join(bytes(x.pcm) for x in parts) == whole
        assert all(bytes(r.media)[x.byte_offset : x.byte_offset + 2] == b"\xff\xf8" for x in parts)
    assert flac.features(flac.store(empty)).count() == 0
    broken = bytearray(bytes(media.first().media))
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        flac.decode_streams([bytes(broken)])


def test_flac_is_stored(spark):
    """Features come of the table read back, and seek points have to lead to their frames."""
    files = queries.op2_flac(spark, DATA).inputFiles()
    assert files and not any("documents.parquet" in f for f in files)
    pay = np.frombuffer(random.Random(1).randbytes(192 * 40), np.uint8)
    good = flac.encode_payloads(pay, np.array([40]))[0]
    at = good.index(bytes([0x83])) + 4 + 18 + 8  # the second seek point's offset
    bad = good[:at] + (int.from_bytes(good[at : at + 8], "big") + 1).to_bytes(8, "big") + good[at + 8 :]
    batch = lambda m: pa.RecordBatch.from_arrays(
        [pa.array([1], pa.int64()), pa.array([7680], pa.int64()), pa.array([m], pa.binary())],
        ["doc_id", "n_bytes", "media"]
    )
    x = pay.astype(int) - 128
    said = f"frames=40 crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())} energy={int((x * x).sum())} peak={int(np.abs(x).max())}"
    assert [r["feature"] for b in flac._features(iter([batch(good)])) for r in b.to_pylist()] == [said]
    with pytest.raises(ValueError):
        list(flac._features(iter([batch(bad)])))


def plain_sketch(text):
    """Each shingle hashed by itself."""
    out = set()
    for s in brute.shingles(text):
        b = " ".join(s).encode()
        out |= set(bottomk.shingle_sets(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0].tolist())
    return sorted(out)[: bottomk.K]


def test_merged_sketches(spark, rows):
    """Sketches of parts, merged by an aggregation, are those of all texts of a key."""
    every = [(i, t, None if k % 5 == 0 else f"k{k % 3}") for k, (i, t) in enumerate(rows)] + [(900, "", "blank")]
    df = spark.createDataFrame(every, "doc_id long, text string, part string").repartition(4)
    prints = bottomk.fingerprints(df).join(df.where("doc_id <> 5").drop("text"), "doc_id").where("doc_id is not null")
    got = {r.part: (bottomk.from_text(r.fingerprint).tolist(), r.n_distinct) for r in bottomk.merged(prints, "part").collect()}
    want = {}
    for i, t, key in every:
        if i is not None and i != 5:
            want.setdefault(key, set()).update(plain_sketch(t))
    assert {k: v[0] for k, v in got.items()} == {k: sorted(v)[: bottomk.K] for k, v in want.items()}
    assert got["blank"] == ([], 0.0)


def test_bottom_k(docs, rows, empty, spark):
    plain = [(i, t) for i, t in rows if i is not None and i != 5] + [(5, rows[5][1])]
    got = {
        r.doc_id: r for r in bottomk.edited_neighbours(spark.createDataFrame(plain, "doc_id long, text string").repartition(5)).collect()
    }
    order = sorted(plain, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b = brute.shingles(t), brute.shingles(edited)
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), brute.sha(edited.encode()))
        exact = len(a & b) / len(a | b) if a or b else 1.0
        assert abs(got[i].near_edited - exact) < 0.25
        # the sketch by its definition: the least hashes of all shingles
        least = [plain_sketch(x) for x in (t, edited, after)]
        assert (got[i].fingerprint, got[i].edited_fingerprint) == tuple(bottomk.to_text(np.array(x, np.uint64)) for x in least[:2])
        for said, other in ((got[i].near_edited, least[1]), (got[i].near_next, least[2])):
            union = sorted({*least[0], *other})[: bottomk.K]
            assert said == (
                sum(
                    h in least[0] and h in other for h in union
                ) / len(union) if union and least[0] and other else float(not least[0] and not other)
            )
        assert got[i].n_distinct == (len(a) if len(a) < bottomk.K else (bottomk.K - 1) * 2.0**64 / (least[0][-1] + 1))
        assert len(a) < bottomk.K or abs(got[i].n_distinct / len(a) - 1) < 0.4
    assert bottomk.edited_neighbours(docs).count() == len(rows)
    assert bottomk.edited_neighbours(empty).count() == 0
    x, y = (np.sort(np.random.default_rng(s).integers(0, 1 << 64, 5000, dtype=np.uint64)) for s in (1, 2))
    sx, sy = bottomk.sketch(x), bottomk.sketch(y)
    assert (bottomk.merge(sx, sy) == bottomk.sketch(np.union1d(x, y))).all()
    assert abs(bottomk.distinct(sx) - 5000) < 1500 and bottomk.containment(sx, bottomk.merge(sx, sy)) >= 0
    assert (bottomk.from_text(bottomk.to_text(sx)) == sx).all()


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    n = [len(tok.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    same(
        token_counts.token_counts(docs, path), ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        [(i, len((t or "").encode()), k, k > 1024) for (i, t), k in zip(rows, n, strict=True)]
    )
    assert token_counts.token_counts(empty, path).count() == 0
    for s in random.Random(1).sample(sorted(token_counts.prove_whole_tokens(path)), 300):
        assert len(tok.encode(s, add_special_tokens=False).ids) == 1


def test_encode_decode(docs, rows, empty, monkeypatch):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), brute.sha(",".join(map(str, ids)).encode()), brute.sha((t or "").encode())))
    cols = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    same(word_shuffle_bpe.encode_decode(docs, path, P.PATTERN), cols, want)
    assert word_shuffle_bpe.encode_decode(empty, path, P.PATTERN).count() == 0
    v = np.array([0, 127, 128, 16383, 16384, 1 << 21, 1 << 30])
    assert (word_shuffle_bpe.unpack(word_shuffle_bpe.pack(v)) == v).all()
    for w in (v, np.arange(70_000) % 997, np.zeros(0, np.int64)):
        assert (word_shuffle_bpe.expand(word_shuffle_bpe.squeeze(w)) == w).all()
    monkeypatch.setattr(word_shuffle_bpe, "BLOCK_WORDS", 50)  # many blocks, and words that are forgotten
    monkeypatch.setattr(word_shuffle_bpe, "KNOWN", 20)
    same(word_shuffle_bpe.encode_decode(docs, path, P.PATTERN), cols, want)


def test_quality(spark, docs, rows, empty):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op5_quality(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    held = [(got[r.doc_id], r.quality) for r in labels if got[r.doc_id].held_out]
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == r.held_out for i, r in got.items())
    assert sum(a.predicted == q for a, q in held) / len(held) > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int")
    forest = gbdt.train(docs, none)
    assert {r.score for r in gbdt.score(docs, forest).collect()} == {0.5}
    assert gbdt.score(empty, forest).count() == 0 and gbdt.keep(docs, forest).columns == docs.columns
    x = np.random.default_rng(0).normal(size=(2000, 3)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    assert ((gbdt.fit(x, y, 60, 4).scores(x) > 0.5) == y).mean() > 0.95


def test_personal_data(spark, docs, rows, empty):
    field = skipchain.learn(docs)
    want = []
    for i, t in rows:
        base = brute.personal(t or "")
        want.append((i, *[sum(k == j for _, k, _ in base) for j in range(4)], brute.sha(skipchain.spell(base).encode())))
    found = skipchain.find(docs, field)
    same(found, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"], want)
    assert skipchain.find(empty, skipchain.learn(empty)).count() == 0
    rng = random.Random(2)
    for _ in range(3000):
        t = "".join(rng.choice("a1@.-+ ()90") for _ in range(rng.randint(0, 60)))
        assert skipchain.base_spans(t) == brute.personal(t)
    hidden = skipchain.redact(docs, field).where("doc_id = 309").first().text
    assert "555" not in hidden and "@" not in hidden and "[CARD]" in hidden


def test_skip_edges_make_labels_agree(spark):
    """With learned weights, numbers written otherwise than a base span take its label through their class, and only so."""
    rng = random.Random(6)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    every = []
    for i in range(300):
        a, b = digits(3), digits(7)
        phone = f"+49 {a} {b}"
        every.append(
            (
                i,
                f"Call {phone} now. " + "word " * rng.randint(5, 40) + rng.choice(
                    [
                        f"Or {phone} again.", f"Version {digits(1)}.{digits(1)} of it, twice {digits(4)}.",
                        f"Mail x{i}@a.example.org or x{i}@a.example.org",
                        f"Order {digits(3)} {digits(7)} of {digits(4)}-{digits(7)}."
                    ]
                )
            )
        )
    field = skipchain.learn(spark.createDataFrame(every, "doc_id long, text string"))
    assert field.agree > 1
    text = "Call +49 301 9018200 today. " + "word " * 200 + "Again 301 9018200, or 0301-9018200; " * 10 + "not 2024 nor 4.5."
    added, linked = field.added(text, skipchain.base_spans(text))
    assert [
        text[s:e] for s, k, e in added
    ] == ["301 9018200", "0301-9018200"] * 10 and {k for _, k, _ in added} == {skipchain.PHONE} and linked == 20
    assert skipchain.Field(field.unary, field.chain, 0.0).added(text, skipchain.base_spans(text))[0] == []
    got = skipchain.find(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), field).collect()
    assert [(r.n_phone, r.n_linked) for r in sorted(got, key=lambda r: r.doc_id)] == [(1, 20), (0, 0)]


def test_messages_give_exact_marginals():
    """On graphs without loops the beliefs are those of counting every labelling; with loops they settle near them."""
    rng = np.random.default_rng(5)
    for case in range(60):
        n, labels = int(rng.integers(2, 6)), 3
        z, chain, agree = rng.normal(size=(n, labels)), rng.normal(size=(labels, labels)), float(rng.uniform(0, 3))
        of = rng.integers(-1, 2, n)
        near = [] if case % 2 else [(i, i + 1) for i in range(n - 1)]
        if case % 2 == 0:
            of[:] = -1
        hubs = int(of.max(initial=-1)) + 1
        total = np.zeros((n, labels))
        for y in np.ndindex(*[labels] * (n + hubs)):
            e = sum(z[i, y[i]] for i in range(n)) + sum(chain[y[a], y[b]] for a, b in near) + agree * sum(
                y[i] == y[n + of[i]] for i in range(n) if of[i] >= 0
            )
            for i in range(n):
                total[i, y[i]] += np.exp(e)
        got = skipchain.propagate(z, near, of, chain, agree, np.full(n, -1))
        assert np.abs(got - total / total.sum(axis=1, keepdims=True)).max() < 1e-6


def test_agreement_over_many_repeats():
    """A class with one clamped member labels all of its twenty repeats, with nothing known of them."""
    clamp = np.append(4, np.full(20, -1))
    got = skipchain.propagate(np.zeros((21, 5)), [], np.zeros(21, int), np.zeros((5, 5)), 3.0, clamp)
    assert (got.argmax(axis=1) == 4).all() and got[1:].max(axis=1).min() > 0.8


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert sorted(r.size for r in got) == sorted(len(brute.WORD.findall(t or "")) for _, t in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    total = sum(r.size for r in got)
    assert abs(sum({r.source_size: r.target for r in got}.values()) - total) < 1e-6 * total
    for key in {r.source_size for r in got}:
        mine = [r for r in got if r.source_size == key]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2 + 1
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    assert mixing.mix(empty).count() == 0
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in got)


def test_induced_order():
    rng = np.random.default_rng(3)
    for _ in range(150):
        n, depth = int(rng.integers(1, 100)), int(rng.integers(1, 30))
        t = rng.integers(97, 97 + int(rng.integers(1, 5)), n, dtype=np.uint8)
        batches = list(induced.suffixes(t, depth, in_memory=int(rng.integers(1, 50))))
        pos, lcp = (np.concatenate([b[i] for b in batches]).tolist() for i in (0, 1))
        cut = lambda i, b=t.tobytes(), d=depth: (b[i:] + b"\0" * d)[:d]
        assert sorted(pos) == list(range(n))
        for a, b, k in zip(pos, pos[1:], lcp[1:], strict=False):
            x, y = cut(a), cut(b)
            assert x >= y and k == next((j for j in range(depth) if x[j] != y[j]), depth)


def test_induced_order_of_texts_beyond_memory():
    """A text many times as long as what is held: runs are merged, queues go to disk, the order is that of a plain sort."""
    rng = np.random.default_rng(4)
    words = [rng.integers(97, 101, int(rng.integers(3, 40)), dtype=np.uint8) for _ in range(40)]
    t = np.concatenate([words[i] for i in rng.integers(0, 40, 3000)])
    depth, counts = 60, {}
    t[rng.integers(0, len(t), 50)] = 0  # zeros are bytes like others
    t[-depth:] = 200  # so that no suffix ends where another has a zero
    want = sorted(range(len(t)), key=lambda i, b=t.tobytes(): (b[i : i + depth] + bytes(depth))[:depth], reverse=True)
    batches = list(induced.suffixes(t, depth, in_memory=500, counts=counts))
    pos, lcp = (np.concatenate([b[i] for b in batches]) for i in (0, 1))
    body = np.concatenate([t, np.zeros(depth, np.uint8)])
    key = lambda i: body[i : i + depth].tobytes()
    assert len(t) > 50_000 and counts["spilled"] > 10_000 and max(len(b[0]) for b in batches) <= 2_000
    assert sorted(pos.tolist()) == list(range(len(t))) and [key(i) for i in pos] == [key(i) for i in want]
    for a, b, k in zip(pos[:-1], pos[1:], lcp[1:], strict=True):
        x, y = body[a : a + depth], body[b : b + depth]
        diff = np.flatnonzero(x != y)
        assert k == (diff[0] if len(diff) else depth)


def test_repeats(spark, rows, empty):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(4)]
    more = [(400 + i, rng.choice(base)[rng.randint(0, 200) :] + "ab" * rng.randint(0, 90) + rng.choice(base)) for i in range(40)]
    every = [r for r in rows if r[0] is not None] + more
    df = spark.createDataFrame(every, "doc_id long, text string")
    same(repeats.remove_repeats(df), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.repeats(every))
    assert repeats.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("period", [68, 69, 70, 138])
def test_repeats_of_one_period(spark, period):
    """Lines repeated within one document, also where a window never holds two copies of its minimizer."""
    rng = random.Random(period)
    line = lambda: "".join(rng.choice("abcdefgh ") for _ in range(period - 1)) + "\n"
    every = [(1, "head " + line() * 5 + "tail"), (2, line() * 3), (3, line() * 2 + line())]
    same(
        repeats.remove_repeats(spark.createDataFrame(every, "doc_id long, text string")),
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.repeats(every)
    )


def test_repeats_of_hot_minimizers(spark, rows, monkeypatch):
    """A line between unique neighbours: its minimizer's windows are dealt out, and no shard is above its bytes."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijkl ") for _ in range(n))
    lines = [word(90), word(130)]
    every = [r for r in rows if r[0] is not None] + [(400 + i, word(60) + lines[i % 2] + word(60)) for i in range(150)]
    df = spark.createDataFrame(every, "doc_id long, text string")
    same(repeats.remove_repeats(df, shard=3000), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.repeats(every))

    kinds = ["gram", "own", "doc", "row", "at", "n"]
    found = [(1 + k // 500, k, k, k, 0, 69) for k in range(503)]  # one minimizer of 500 segments, one of 3
    batches = [pa.RecordBatch.from_pylist([dict(zip(kinds, r, strict=True)) for r in found[i : i + 90]]) for i in range(0, len(found), 90)]
    out = pa.Table.from_batches([b for b in repeats._resolve(iter(batches), shard=168 * 200) if b.num_rows]).to_pylist()
    assert [r["gram"] for r in out if r["kind"] == 2] == [1]

    sizes = []
    monkeypatch.setattr(repeats, "_repeats", lambda held: sizes.append(held.size))
    table = pa.table(
        {
            "gram": pa.array([k // 7 for k in range(140)], pa.int64()), "n": pa.array([69] * 140, pa.int32()),
            "bytes": pa.array([b"x" * 168] * 140, pa.binary())
        }
    )
    list(repeats._sort_shards(iter(table.to_batches(max_chunksize=33)), shard=2000))
    assert len(sizes) > 5 and max(sizes) <= 2000


def test_warc(spark):
    long = "x" * 200 + "WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\nq"
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 3
    pages = [
        (1, "u", long), (2, "a b\r\nX: y", None), (5, None, "y" * 100), (3, "z", "y" * 100), (None, "k", "y" * 100),
        (3, "z", "y" * 100), (7, "é", fake), (8, "é", fake), (9, "w", "\r\n\r\n"), (10, "w", "short"),
        (11, "w", "short")
    ]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want, first, done = [], {}, set()
    for i, _, h in pages:
        h = h or ""
        if len(h.encode()) >= 100:
            first[h] = min((i is None, i or 0), first.get(h, (True, 0)))
    for i, _, h in pages:
        h = h or ""
        f = first.get(h)
        new = f is None or ((i is None, i or 0) == f and h not in done)
        if f is not None and new:
            done.add(h)
        want.append((i, len(h.encode()), sha(h), "response" if new else "revisit", None if new else f[1]))
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, row int")
    same(warc.archive_round_trip(df), ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], want)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA).collect()
    clean = corpus_pipeline.quality(spark, docs, DATA)
    one = corpus_pipeline.near_duplicates(spark, clean, DATA)
    left = {r.doc_id for r in one.collect()}
    groups = brute.near_duplicates([(r.doc_id, r.text) for r in clean.collect()])
    assert left == {c for _, _, c, k in groups if k}
    assert {r.doc_id for r in out} <= left and all(r.n_tokens >= 0 for r in out)
    masked = {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, one, DATA).collect()}
    assert not any(brute.personal(t) for t in masked.values())
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in masked.items()}
    assert all(r.decoded_sha256 == want[r.doc_id] for r in out)


@pytest.mark.parametrize("coarse", [1, 2, 3])
def test_ranges_divided_by_width(spark, monkeypatch, coarse):
    monkeypatch.setattr(bottomk, "COARSE", coarse)
    rng = random.Random(coarse)
    rows = [
        (int(2 ** (k / 5)), "".join(rng.choice("ab c") for _ in range(rng.randint(0, 40)))) for k in range(60, 200)
    ] + [(-(1 << 63) + 5, "least"), ((1 << 63) - 1, "most")]
    rows = list(dict(rows).items())
    order = sorted(rows, key=lambda r: -r[0])
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        want.append((i, brute.sha((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode())))
    same(
        bottomk.edited_neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)),
        ["doc_id", "edited_sha256"], want
    )


def test_hot_and_missing_ids(spark):
    rng = random.Random(9)
    text = lambda: "".join(rng.choice("ab c\u00e9") for _ in range(rng.randint(0, 60)))
    rows = [(None, text()) for _ in range(700)] + [(7, text()) for _ in range(700)] + [(7, "same rows")] * 40 + [(None, None)] * 3
    rows += [(rng.randint(-1000, 1000), text()) for _ in range(600)] + [(-1001, text()) for _ in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    hashed = df.selectExpr("doc_id", "coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h, r.t))
    want = []
    for k, r in enumerate(order):
        t, after = r.t, order[(k + 1) % len(order)].t
        want.append((r.doc_id, brute.sha((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode())))
    got = bottomk.edited_neighbours(df)
    same(got, ["doc_id", "edited_sha256"], want)
    tasks = got.select("doc_id", F.spark_partition_id().alias("p")).groupBy("doc_id").agg(F.countDistinct("p").alias("n"))
    spread = {r.doc_id: r.n for r in tasks.collect()}
    assert min(spread[None], spread[7]) > 1


def test_mixing_against_plain_dual(spark):
    """Targets by another water-filling, rates by halving on the dual, copies one by one."""
    rng = random.Random(4)
    share = {"a": 40, "b": 25, "c": 3, "d": 60, None: 12, "é": 6}
    every = [
        (k, " ".join(["w"] * int(rng.lognormvariate(3, 1.2))), s) for s,
        n in share.items() for k in range(1000 * len(s or ""), 1000 * len(s or "") + n)
    ]
    every = [(k, *r[1:]) for k, r in enumerate(every)]
    df = spark.createDataFrame(every, "doc_id long, text string, source string").repartition(5)
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    order = sorted({s for s in share if s is not None}) + [None]
    size = {s: sum(len(t.split()) for _, t, o in every if o == s) for s in order}
    goal = dict(zip(order, brute.water([size[s] for s in order], [mixing.WEIGHTS[k % 3] for k in range(len(order))], 3), strict=True))
    kept = [(i, s, len(t.split())) for i, t, s in every]
    docs = [(s, q) for _, s, q in kept]
    assert all(abs(got[i].target - goal[s]) < 1e-6 * goal[s] for i, s, _ in kept)
    assert any(goal[s] == 3 * size[s] for s in order)
    rate = brute.rates(docs, goal, 3, mixing.RIDGE)
    assert len(
        {round(r, 6) for r, (s, _) in zip(rate, docs, strict=True) if s == "a"}
    ) > 5  # documents of one source have rates of their own
    assert max(abs(got[i].rate - r) for (i, _, q), r in zip(kept, rate, strict=True) if q) < 1e-5
    keys = {r.doc_id: r.key for r in df.select("doc_id", mixing._key().alias("key")).collect()}
    want = brute.copies(docs, [keys[i] for i, _, _ in kept], [got[i].rate for i, _, _ in kept], goal, 3, mixing.FILL)
    assert [got[i].copies for i, _, _ in kept] == want
    taken = mixing.take(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in taken} == {i: n for (i, _, _), n in zip(kept, want, strict=True) if n}


def test_mixing_many_sources(spark, monkeypatch):
    """Sources beyond what is broadcast give the same rows; equal rows are taken alike."""
    every = [(k, "w " * (1 + k % 13), f"s{k % 17}") for k in range(170)] + [(5, "w " * 6, "s5")] * 3
    df = spark.createDataFrame(every, "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "FEW", 4)
    got = sorted(map(tuple, mixing.mix(df).collect()))
    assert [r[:5] for r in got] == [r[:5] for r in want] and len({r for r in got if r[0] == 5}) == 1


@pytest.fixture
def moving(spark, monkeypatch):
    """Scans are dealt out otherwise after every table and checkpoint, as when executors come and go."""
    keys = ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k, None) for k in keys}
    turn = [0]

    def wrap(fn):
        def run(*a, **k):
            out = fn(*a, **k)
            turn[0] += 1
            spark.conf.set(keys[0], str([2, 13, 5][turn[0] % 3]))
            spark.conf.set(keys[1], ["1m", "20k", "128m"][turn[0] % 3])
            spark.conf.set(keys[2], ["1k", "4m", "10k"][turn[0] % 3])
            return out

        return run

    for m in (warc, mixing, repeats, word_shuffle_bpe, cpsjoin):
        for name in ("cut", "stored", "stored_by"):
            if hasattr(m, name):
                monkeypatch.setattr(m, name, wrap(getattr(m, name)))
    yield turn
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_results_stay_when_executors_change(spark, tmp_path, moving):
    rng = random.Random(8)
    prose = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(100, 700))) for _ in range(60)]
    every = [(i, prose[rng.randint(0, 59)] + prose[i % 60][:90], f"s{i % 4}") for i in range(300)]
    df = spark.createDataFrame(every, "doc_id long, text string, source string")
    df.repartition(12).write.parquet(str(tmp_path / "docs"))
    shuffled = lambda: spark.read.parquet(str(tmp_path / "docs")).repartition(7, F.xxhash64("text"))
    plain = lambda: spark.read.parquet(str(tmp_path / "docs"))
    taken = {}
    for read in (plain, shuffled):
        same(
            repeats.remove_repeats(read()), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            brute.repeats([r[:2] for r in every])
        )
        back = word_shuffle_bpe.encode_decode(read(), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
        same(back, ["doc_id", "decoded_sha256"], [(i, brute.sha(t.encode())) for i, t, _ in every])
        pages = read().select(
            F.col("doc_id").alias("page_id"), F.lit("u").alias("url"),
            F.concat(
                F.element_at(F.split("text", "a"), 1), F.substring("text", 1, 90),
                F.when(F.col("doc_id") % 3 == 0, "WARC/1.1\r\nx").otherwise("")
            ).alias("html")
        )
        html = {r.page_id: r.html for r in pages.collect()}
        first = {}
        for i, h in html.items():
            if len(h) >= 100:
                first[h] = min(i, first.get(h, i))
        want = [
            (i, len(h), brute.sha(h.encode()), *(("revisit", first[h]) if first.get(h, i) != i else ("response", None))) for i,
            h in html.items()
        ]
        same(warc.archive_round_trip(pages), ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], want)
        taken[read] = sorted(map(tuple, mixing.take(read()).collect()))
        copies = {r.doc_id: r.copies for r in mixing.mix(read()).collect()}
        assert len(taken[read]) == sum(copies.values())
    assert taken[plain] == taken[shuffled] and moving[0] > 20


def test_jump(spark, monkeypatch):
    rng = np.random.default_rng(1)
    for _ in range(300):
        at = np.unique(np.append(rng.integers(0, 100, int(rng.integers(1, 40))), 0))
        after = at + rng.integers(1, 12, len(at))
        step, want, x = dict(zip(at.tolist(), after.tolist(), strict=True)), [], 0
        while x in step:
            want.append(x)
            x = step[x]
        p = rng.permutation(len(at))
        assert sorted(warc.jump(at[p], after[p]).tolist()) == want
    monkeypatch.setattr(warc, "JUMPED", 0)  # all files by joins
    test_warc(spark)


def test_words_that_polynomials_confuse(spark):
    """Words of the Thue-Morse sequence, whose sums of powers are equal modulo 2^64, make unlike sets."""
    thue = lambda n, a, b: "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))
    every = [
        (10 * n + k, f"one two three four {thue(n, *pair)}") for n in (1024, 2048, 4096, 8192) for k,
        pair in enumerate((("a", "b"), ("b", "a")))
    ]
    df = spark.createDataFrame(every, "doc_id long, text string")
    assert all(r.kept and r.n_shingles == 1 for r in cpsjoin.near_duplicates(df).collect())
    got = bottomk.fingerprints(df).collect()
    assert len({r.fingerprint for r in got}) == len(every)


class BitWriter:
    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [(v >> (n - 1 - i)) & 1 for i in range(n)]

    def unary(self, n):
        self.bits += [0] * n + [1]

    def bytes(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return np.packbits(np.array(self.bits, np.uint8)).tobytes()


def written_frame(number, x, kind, bits=16, wasted=0, shift=4, coef=(), parts=0, escape=()):
    """A frame by the format's description, one bit after another; x has 192 samples."""
    w = BitWriter()
    for v, n in ((0x3FFE, 14), (0, 2), (1, 4), (0, 4), (0, 4), (4 if bits == 16 else 1, 3), (0, 1)):
        w.put(v, n)
    for byte in chr(number).encode():
        w.put(byte, 8)
    w.put(flac._scalar_crc(w.bytes(), 8), 8)
    w.put(0, 1)
    w.put(kind, 6)
    w.put(1 if wasted else 0, 1)
    if wasted:
        w.unary(wasted - 1)
    x, bits = [v >> wasted for v in x], bits - wasted
    if kind == 1:
        for v in x:
            w.put(v, bits)
    else:
        order = kind - 31 if kind >= 32 else kind - 8
        for v in x[:order]:
            w.put(v, bits)
        if kind >= 32:
            w.put(11, 4)
            w.put(shift, 5)
            for c in coef:
                w.put(c, 12)
        else:
            coef, shift = flac.FIXED[order], 0
        w.put(0, 2)
        w.put(parts, 4)
        at = order
        for p in range(1 << parts):
            n = (192 >> parts) - (order if p == 0 else 0)
            rest = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coef)) >> shift) for i in range(at, at + n)]
            at += n
            if p in escape:
                w.put(15, 4)
                w.put(17, 5)
                for r in rest:
                    w.put(r, 17)
                continue
            k = 3 + p % 4
            w.put(k, 4)
            for r in rest:
                u = r * 2 if r >= 0 else -2 * r - 1
                w.unary(u >> k)
                w.put(u, k)
    body = w.bytes()
    return body + flac._scalar_crc(body, 16).to_bytes(2, "big")


def test_flac_of_other_writers():
    """Quantised predictors, partitions, escapes, verbatim and wasted bits, and seeks that decode from their point only."""
    rng = np.random.default_rng(2)
    wave = (np.sin(np.arange(192 * 6) / 9) * 900 + rng.integers(-9, 9, 192 * 6)).astype(int)
    blocks = [wave[i : i + 192].tolist() for i in range(0, len(wave), 192)]
    blocks[4] = [v << 3 for v in blocks[4]]
    frames = [
        written_frame(0, blocks[0], 33, coef=(28, -13)), written_frame(
            1, blocks[1], 34, coef=(20, 3, -9), parts=2
        ), written_frame(2, blocks[2], 10, parts=3, escape=(0, 5)), written_frame(3, blocks[3], 1),
        written_frame(4, blocks[4], 12, wasted=3), written_frame(5, blocks[5], 32, coef=(15,), parts=1, escape=(1,)),
    ]
    want = np.concatenate(blocks)
    at = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
    seek = b"".join(int(192 * i).to_bytes(8, "big") + int(at[i]).to_bytes(8, "big") + (192).to_bytes(2, "big") for i in (0, 2, 4))
    info = (192).to_bytes(2, "big") * 2 + bytes(6) + ((8000 << 44) | (15 << 36) | len(want)).to_bytes(8, "big") + bytes(16)
    head = b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek
    stream = head + b"".join(frames)
    assert (flac.decode_stream(stream) == want).all()
    broken = bytearray(stream)
    broken[len(head) + 9] ^= 4  # in the first frame: seeks beyond it don't read it
    with pytest.raises(ValueError):
        flac.decode_stream(bytes(broken))
    for first, n in ((384, 192), (500, 300), (1151, 1), (900, 999), (2000, 5)):
        assert (flac.read_samples(bytes(broken), first, n) == want[first : first + n]).all()
    assert (flac.read_samples(stream, 0, 3) == want[:3]).all()
    own = flac.encode_payloads(np.frombuffer(random.Random(3).randbytes(192 * 50), np.uint8), np.array([50]))[0]
    assert (flac.read_samples(own, 5000, 700) == flac.decode_stream(own)[5000:5700]).all()
    code, n = flac._number(np.array([0x7F, 0x80, 0xFFFF, 0x10000, 0x1FFFFF, 0x200000, 0x3FFFFFF, 0x4000000]))
    assert n.tolist() == [1, 2, 3, 4, 4, 5, 5, 6] and all(
        code[i, : n[i]].tobytes() == chr(v).encode("utf-8", "surrogatepass") for i,
        v in enumerate([0x7F, 0x80, 0xFFFF, 0x10000])
    )
    with pytest.raises(ValueError):
        flac._number(np.array([1 << 31]))


def test_trees_against_plain_ones():
    """The first tree's splits by trying all of them, and scores by walking each tree for each row."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 4)).astype(np.float32)
    x[:, 2] = np.round(x[:, 2])  # ties
    y = ((x[:, 1] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    forest = gbdt.fit(x, y, 5, 3)
    walked = []
    for row in x:
        z = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(row[f[at]] > t[at])
            z += leaf[at - len(f)]
        walked.append(1 / (1 + np.exp(-z)))
    assert np.abs(forest.scores(x) - walked).max() < 1e-12
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + gbdt.L2)

    def best(rows):
        found = (1e-6, None)
        for j in range(4):
            for e in np.unique(np.quantile(x[:, j], np.linspace(0, 1, gbdt.BINS + 1)[1:-1]).astype(np.float32)):
                left = rows & (x[:, j] <= e)
                right = rows & ~left
                if min(h[left].sum(), h[right].sum()) < gbdt.LEAST_WEIGHT:
                    continue
                gain = score(left) + score(right) - score(rows)
                if gain > found[0] + 1e-9:
                    found = (gain, (j, e))
        return found[1]

    root = np.ones(len(y), bool)
    want = best(root)
    assert (forest.feature[0, 0], forest.threshold[0, 0]) == want
    for node, side in ((1, x[:, want[0]] <= want[1]), (2, x[:, want[0]] > want[1])):
        assert (forest.feature[0, node], forest.threshold[0, node]) == best(side)


def test_pipeline_on_awkward_tables(spark, docs, tmp_path):
    """Empty tables, no labels, nulls, repeats and columns with clashing names run through all stages."""
    import corpus_pipeline

    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, table in (("empty", docs.limit(0)), ("some", docs)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        none.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert (out.count() == 0) == (name == "empty") and out.columns[:2] == ["doc_id", "n_tokens"]
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, f"{tmp_path}/some")
        assert left.columns == docs.columns, name
