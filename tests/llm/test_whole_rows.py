"""Whole results of queries and stages without SQL against plain versions, and texts of a million characters."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from pactlake.llm import bottomk, cpsjoin, flac, gbdt, line_runs, mixing, queries, repeats, skipchain, token_counts, word_shuffle_bpe
from tests.llm import brute
from tests.llm.test_lines_codes_links import brute_lines

DATA = "/root/testdata/sf0.001"


def plain_quality(docs, labels):
    """(doc_id, text) and (doc_id, quality) -> {doc_id: (held out, score)}: counted statistics, trees walked node by node."""
    stats = {i: brute.statistics(t or "") for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in stats}
    known = sorted((i, q) for i, q in labels if q is not None and i in stats and not held[i])
    forest = gbdt.fit(np.array([stats[i] for i, _ in known]), np.array([float(q) for _, q in known]))
    return {i: (held[i], brute.walked(forest, x)) for i, x in stats.items()}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    return docs, rows, plain_quality(rows, labels)


def test_statistics_by_counting(tables):
    texts = [t or "" for _, t in tables[1]] + ["", " \n", "a", "A b", "é\n\né\nX", "HTTP 200 (OK)! a,b\na,b\n", "one two three four", "x y x y x y x y"]
    data = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(b) for b in data])])
    got = gbdt.statistics(np.frombuffer(b"".join(data), np.uint8), offs)
    for t, a in zip(texts, got, strict=True):
        assert np.abs(a - brute.statistics(t)).max() < 2e-5, t[:50]


def test_quality_rows(spark, tables):
    got = {r.doc_id: r for r in queries.op5_quality(spark, DATA).collect()}
    assert got.keys() == tables[2].keys()
    for i, (held, score) in tables[2].items():
        assert got[i].held_out == held and abs(got[i].score - score) < 1e-3
        assert abs(score - gbdt.THRESHOLD) < 1e-3 or got[i].predicted == (score >= gbdt.THRESHOLD)


def test_pipeline_rows(spark, tables):
    """Every stage on its own input: what it keeps, masks, repeats and encodes."""
    import tiktoken

    import corpus_pipeline

    docs, rows, quality = tables
    cut = lambda df: {r.doc_id: r.text for r in df.collect()}
    clean = corpus_pipeline.quality(spark, docs, DATA).persist()
    assert cut(clean) == {i: t for i, t in rows if quality[i][1] >= gbdt.THRESHOLD}
    one = corpus_pipeline.near_duplicates(spark, clean, DATA).persist()
    assert set(cut(one)) == {c for _, _, c, kept in brute.near_duplicates(list(cut(clean).items())) if kept}
    masked = corpus_pipeline.personal_data(spark, one, DATA).persist()
    field = skipchain.learn(one)
    said = {r.doc_id: r.spans for r in skipchain.find(one, field).collect()}
    for i, t in cut(one).items():
        spans = [(int(s), skipchain.KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in said[i].split(",") if x)]
        want, at = "", 0
        for s, k, e in spans:
            want, at = (want + t[at:s] + f"[{skipchain.KINDS[k].upper()}]", e) if s >= at else (want, max(at, e))
        assert cut(masked)[i] == want + t[at:] and {*brute.personal(t)} <= {*spans} if spans else cut(masked)[i] == t
    mixed = corpus_pipeline.mix_sources(spark, masked, DATA).persist()
    before = {r.doc_id: (r.source, len(brute.WORD.findall(r.text or ""))) for r in masked.collect()}
    sizes, taken, times = defaultdict(int), defaultdict(int), defaultdict(int)
    for s, q in before.values():
        sizes[s] += q
    for r in mixed.collect():
        taken[r.source] += len(brute.WORD.findall(r.text or ""))
        times[r.doc_id] += 1
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(names, brute.water([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 3), strict=True))
    assert max(times.values()) <= 3 and times.keys() <= before.keys()
    for s in names:
        assert abs(taken[s] - goal[s]) <= max(q for n, q in before.values() if n == s) / 2 + 1
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in mixed.collect():
        ids = enc.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), brute.sha(",".join(map(str, ids)).encode()), brute.sha((r.text or "").encode())))
    out = corpus_pipeline.encode(spark, mixed, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, out)) == sorted(want)


def test_texts_of_a_million_characters(spark):
    """Two long texts that differ in some words, a copy, and short ones, through the operators on documents."""
    import tiktoken
    from tokenizers import Tokenizer

    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeghiknorsté") for _ in range(rng.randint(2, 9))) for _ in range(9000)]
    words = [rng.choice(vocabulary) + ("\n" if rng.random() < 0.05 else "") for _ in range(160_000)]
    long, near = " ".join(words) + " mail a.b@c.example.org", " ".join("new" if i % 4000 == 9 else w for i, w in enumerate(words))
    assert min(len(long), len(near)) > 1_000_000
    rows = [(1, long), (2, near), (3, "short text"), (4, long), (5, None), (6, "short text")]
    docs = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    got = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    want = [tuple(x) for x in brute.near_duplicates(rows)]
    assert got(cpsjoin.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == want
    pay = {}
    for i, t in rows:
        b = (t or "").encode()
        pay[i] = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
    assert got(flac.features(flac.store(docs)), "doc_id", "payload_bytes", "payload_sha256", "tail_crc32") == [
        (i, len(p), brute.sha(p), zlib.crc32(p[-16:])) for i, p in pay.items()
    ]
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    edits = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edits.append((i, len(t), brute.sha((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode())))
    assert got(bottomk.edited_neighbours(docs), "doc_id", "n_chars", "edited_sha256") == sorted(edits)
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    assert got(token_counts.token_counts(docs, path), "doc_id", "n_tokens") == [(i, len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    x = gbdt.statistics(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long.encode())]))
    assert np.abs(x[0] - brute.statistics(long)).max() < 1e-4
    found = {r.doc_id: r for r in skipchain.find(docs, skipchain.learn(docs)).collect()}
    assert all(found[i].base_sha256 == brute.sha(skipchain.spell(brute.personal(t or "")).encode()) for i, t in rows) and found[1].n_email == 1
    assert got(mixing.mix(docs), "doc_id", "size") == [(i, len(brute.WORD.findall(t or ""))) for i, t in rows]
    assert got(repeats.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == [tuple(x) for x in brute.repeats(rows)]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: enc.encode_ordinary(t or "") for i, t in rows}
    assert got(word_shuffle_bpe.encode_decode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), "doc_id", "ids_sha256", "decoded_sha256") == [
        (i, hashlib.sha256(",".join(map(str, ids[i])).encode()).hexdigest(), brute.sha((t or "").encode())) for i, t in rows
    ]
    assert got(line_runs.line_dedup(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(tuple(x) for x in brute_lines(rows))
