"""Line dedup, vector codes and token links against brute force, on awkward tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from pactlake.llm import line_runs, token_links, yinyang
from tests.llm.test_operators import awkward_rows

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
DOCS = "doc_id long, text string, hash long, pos int, pair long, block long, dropped int"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 1, 1, 1, 1) for i, t in rows], DOCS).repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def line_rows():
    rng = random.Random(3)
    line = lambda k: f"This sentence number {k} is long enough to be a key of its own."
    rows = [
        (i, "\n".join(rng.choice(["", " \t", "short", line(rng.randrange(9)), line(rng.randrange(40)).upper() + "\r"]) for _ in range(rng.randrange(9))))
        for i in range(60)
    ]
    rows += [(i, "É" * 39 + "\n" + "É" * 40 + "\n" + "é" * 40 + "\n") for i in range(100, 106)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, line(1)), (None, line(1) + "\n" + line(2)), (None, None)]
    rows += [(300, line(3)), (300, line(3)), (300, line(3) + "\n" + line(4)), (301, "\n".join([line(3)] * 3))]
    rows += [(400, "\n".join(["x" * 1_000_000, *[line(5)] * 3000]))]
    rows += [(500 + i, "  \v" + "Z" * 40 + "\f \n" + "zz" * 20) for i in range(7)]
    return rows + awkward_rows()


def brute_lines(rows):
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip("\t\n\v\f\r "))
    seen = defaultdict(set)
    for i, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= 40:
                seen[key(s)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        bad = [len(key(s)) >= 40 and len(seen[key(s)]) >= 5 and (-1 if i is None else i) < max(seen[key(s)]) for s in lines]
        out.append((i, len(lines), sum(bad), SHA("\n".join(s for s, b in zip(lines, bad, strict=True) if not b))))
    return sorted(out, key=repr)


def test_lines(spark):
    rows = line_rows()
    assert got(line_runs.line_dedup(docs(spark, rows))) == brute_lines(rows)
    assert got(line_runs.line_dedup(docs(spark, rows).limit(0))) == []


def test_runs_know_what_is_common_and_stay_few(spark):
    lines = line_runs.line_hashes(docs(spark, line_rows())).persist()
    want = got(
        lines.select("hash", "check", "doc_id").distinct().groupBy("hash", "check")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where("n >= 5").drop("n")
    )
    assert want
    runs, held = line_runs.Runs(spark), []
    for b in range(7):
        batch = lines.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(7)) == 6 - b)
        runs.add(batch)
        held.append(sorted(runs.levels))
    assert held == [[0], [1], [0, 1], [2], [0, 2], [1, 2], [0, 1, 2]]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = runs._merged(*runs.runs()[:2])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert got(runs.common_keys()) == want
    # a batch that came before has nothing that the runs don't make needless, but for keys that aren't common, or whose last document it holds
    own = lines.where("doc_id < 50").groupBy("hash", "check").agg(F.countDistinct("doc_id").alias("documents"), F.max("doc_id").alias("last"))
    common = {(h, c): last for h, c, last in want}
    left = {(r.hash, r.check) for r in runs.unknown(own).collect()}
    assert left == {(r.hash, r.check) for r in own.collect() if common.get((r.hash, r.check), -1) <= r.last}
    runs.close()
    lines.unpersist()


def test_lines_stay_in_the_jvm(spark):
    plan = line_runs.line_dedup(docs(spark, line_rows()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = sorted((i, [int(np.floor(1024.0 * x)) for x in v], y) for i, v, y in rows)
    x = np.array([v for _, v, _ in kept], dtype=object)
    width, out, books = x.shape[1] // parts, [], []
    for p in range(parts):
        own = x[:, p * width : (p + 1) * width]
        book = [list(r) for r in own[:entries]]
        near = lambda r, b: min((sum((u - w) ** 2 for u, w in zip(r, e, strict=True)), k) for k, e in enumerate(b))
        for _ in range(rounds):
            at = [near(r, book)[1] for r in own]
            for k in set(at):
                mine = [r for r, a in zip(own, at, strict=True) if a == k]
                book[k] = [sum(r[j] for r in mine) // len(mine) for j in range(width)]
        out.append([near(r, book) for r in own])
        books += [v for e in book for v in e]
    error = [sum(o[n][0] for o in out) for n in range(len(kept))]
    by = Counter()
    for e, (_, _, y) in zip(error, kept, strict=True):
        by[y] += e
    return sorted(
        ((i, "".join(f"{o[n][1]:02x}" for o in out), error[n], by[y], SHA(",".join(map(str, books)))) for n, (i, _, y) in enumerate(kept)), key=repr
    )


VECTORS = "vec_id long, embedding array<float>, label int, code string, own int, dist double"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2.0) for r in rows], VECTORS).repartition(3)


def test_codes(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(0, 1, (400, 8)), 1).astype(np.float32)  # coarse, so distances are often equal
    rows = [(int(i), [float(x) for x in r], None if i % 5 == 0 else int(i) % 3) for i, r in enumerate(v)]
    rows += [(1000 + i, rows[i][1], 7) for i in range(20)] + [(399, rows[3][1], 1), (500, [0.5] * 8, 2)]
    bad = [(2000, None, 1), (2001, [float("nan")] * 8, 1), (2002, [None, *[0.0] * 7], 1), (2003, [float("inf")] * 8, None), (2004, [], 1), (2005, [1.0] * 4, 1)]
    assert got(yinyang.vector_codes(vectors(spark, rows + bad))) == brute_codes(rows)
    assert got(yinyang.vector_codes(vectors(spark, rows[:3]))) == brute_codes(rows[:3])
    assert yinyang.vector_codes(vectors(spark, bad[:4])).count() == 0
    assert yinyang.vector_codes(vectors(spark, rows).limit(0)).count() == 0
    with_null = yinyang.vector_codes(vectors(spark, [*rows[:300], (None, rows[0][1], 1)])).where("vec_id is null").collect()
    assert len(with_null) == 1
    with pytest.raises(ValueError, match="too large"):
        yinyang.vector_codes(vectors(spark, [(1, [1e12] * 8, 1)]))
    with pytest.raises(ValueError, match="equal parts"):
        yinyang.vector_codes(vectors(spark, [(1, [1.0] * 6, 1)]))


def test_bounds_spare_scans_and_lose_no_entry(spark):
    rng = np.random.default_rng(1)
    heads = rng.normal(0, 3, (40, 16))
    x = [[float(c) for c in heads[i % 40] + rng.normal(0, 0.2, 16)] for i in range(3000)]
    coded = yinyang.encode(vectors(spark, [(i, r, 0) for i, r in enumerate(x)]))
    assert coded.scanned[-1] < coded.scanned[0] / 2
    for row in coded.rows.limit(200).collect():
        v, own, dist = np.frombuffer(row.x, "<i4").astype(np.int64), np.frombuffer(row.own, "<i2"), np.frombuffer(row.dist, "<i8")
        for p, b in enumerate(coded.books):
            d = ((b.entries - v[p * 4 : p * 4 + 4]) ** 2).sum(1)
            assert (d.argmin(), d.min()) == (own[p], dist[p])


@pytest.mark.parametrize("most", [10, 1 << 28])
def test_squares_are_exact_in_either_arithmetic(most):
    rng = np.random.default_rng(2)
    x, e = rng.integers(-most, most, (50, 4)), rng.integers(-most, most, (7, 4))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for s in e] for r in x]
    assert yinyang.squares(x, e).tolist() == want
    d = np.array([0, 1, 2, 3, 4, (1 << 31) ** 2 - 1, (1 << 31) ** 2], np.int64)
    assert yinyang.floor_root(d).tolist() == [0, 1, 1, 1, 2, (1 << 31) - 1, 1 << 31]
    assert yinyang.ceil_root(d).tolist() == [0, 1, 2, 2, 2, 1 << 31, 1 << 31]


def brute_links(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    a_bytes = token_links.ByteLevel(A).bytes
    b_bytes = [bytes([int(s[3:5], 16)]) if sp.is_byte(i) else s.replace("▁", " ").encode() for i, s in ((i, sp.id_to_piece(i)) for i in range(sp.vocab_size()))]
    ends = lambda ids, spelled: np.cumsum([len(spelled[i]) for i in ids]).tolist()
    found, count = [], Counter()
    for i, t in rows:
        a, b = tok.encode(f" {t or ''}", add_special_tokens=False).ids, sp.encode(t or "")
        whole = f" {t}".encode()
        if not t or b"".join(a_bytes[k] for k in a) != whole or b"".join(b_bytes[k] for k in b) != whole:
            found.append((i, 0, 0, 0, [], ""))
            continue
        x, y = ends(a, a_bytes), ends(b, b_bytes)
        links, p, q = [], 0, 0
        while p < len(a) and q < len(b):  # walk both lists side by side
            links.append((a[p], b[q]))
            p, q = p + (x[p] <= y[q]), q + (y[q] <= x[p])
        groups, p, q = [], 0, 0
        for c in sorted(set(x) & set(y)):
            n, m = x.index(c, p) + 1, y.index(c, q) + 1
            groups.append(",".join(map(str, a[p:n])) + "|" + ",".join(map(str, b[q:m])))
            p, q = n, m
        count.update(links)
        found.append((i, len(a), len(b), len(groups), links, SHA(";".join(groups))))
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted(
        ((i, na, nb, g, len(k), sum(count[x] == top[x[1]] for x in k), sum(count[x] for x in k), s) for i, na, nb, g, k, s in found), key=repr
    )


def test_links(spark, monkeypatch):
    rows = awkward_rows() + [
        (600, " "), (601, "a▁b"), (602, "<|endoftext|> <s> </s> <unk> <0x41>"), (603, "日本語 テキスト　é\x00\x01 \n\n  a   "), (604, "  "),
        (605, "don't we'll  \r\n\tx"), (606, "\U0001f600\U0001f600 ½ ſ"), (607, " ".join(f"w{k % 977}" for k in range(60_000)))
    ]
    want = brute_links(rows)
    assert got(token_links.token_links(docs(spark, rows), A, B)) == want
    assert token_links.token_links(docs(spark, rows).limit(0), A, B).count() == 0


def test_links_by_small_slices_and_blocks(monkeypatch):
    """Blocks number pairs anew; caches that overflow begin anew."""
    monkeypatch.setattr(token_links, "CACHE", 50)
    a, b = token_links.ByteLevel(A), token_links.SentencePiece(B)
    names = token_links._names(len(a.bytes), len(b.bytes))
    rows = [(i, t or "") for i, t in awkward_rows()]
    whole = token_links.align([i for i, _ in rows], [t for _, t in rows], a, b, names)
    block, pieces = token_links._Block(0), []
    for i, t in rows:
        got = token_links.align([i], [t], a, b, names)
        pieces += got[0]
        block.add(*got, 1)
    assert pieces == whole[0]
    out = list(block.rows())
    pairs = {p: n for o in out for p, n in zip(o.column("pair").to_pylist(), o.column("n").to_pylist(), strict=True) if p is not None}
    assert pairs == dict(zip(whole[1].tolist(), whole[2].tolist(), strict=True))
    keys = sorted(pairs)
    assert keys == whole[1].tolist()
    spots = [np.cumsum(token_links.unpack(s)).tolist() for o in out for s in o.column("places").to_pylist() if s is not None]
    assert spots == [p.tolist() for p in whole[3]]


def test_bits():
    rng = np.random.default_rng(0)
    for size in (1, 63, 64, 65, 1000):
        at = np.flatnonzero(rng.random(size) < 0.3)
        bits, places = token_links.Bits.at(at, size), np.arange(size)
        assert bits.places().tolist() == at.tolist()
        assert bits.rank(places).tolist() == [int((at < p).sum()) for p in places]


def test_more_blocks_than_buckets(spark, monkeypatch):
    """Where Spark allows fewer buckets than there are parts, a bucket holds several blocks."""
    from pactlake.llm import word_shuffle_bpe

    monkeypatch.setattr(word_shuffle_bpe, "BLOCK_WORDS", 50)
    run = lambda: got(word_shuffle_bpe.encode_decode(docs(spark, awkward_rows()), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN))
    want = run()
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "2")
    try:
        assert run() == want
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
