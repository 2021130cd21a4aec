"""Each operator against a brute-force version, and on odd rows."""

import collections
import hashlib
import itertools
import random
import re
import string
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codicil.llm import license_scan, merkle, mixing, ngram_join, packing, quality, secret_scan, similar, substring_dedup, token_counts, token_files
from codicil.llm.queries import ORACLE_SQL, QUERIES
from codicil.llm.tokens import BYTE_BPE, WORD_BPE, encoder, tokenizer_path

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text):
    w = WORD.findall(text or "")
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def links_of(sets):
    """Pairs of keys whose sets have a similarity of 0.8 or more."""
    found = []
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
            found.append((a, b))
    return found


def roots_of(keys, pairs):
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("name", [WORD_BPE, BYTE_BPE])
def test_encoder_gives_the_librarys_ids(name, texts):
    t = Tokenizer.from_file(tokenizer_path(name))
    odd = ["", " ", "a  b", "\n\n x", " a ", "a\n\n\nb", "a \n b", "a\tb \n c", "it's 'x", "<|endoftext|>x", "\x1cab cd", "á ́b", "x 　y", "a\r\nb", "İx ß. Ab ,a word.,", "ΑΣ ΣΑΣ"]
    for text in odd + list(texts.values())[:60]:
        assert np.frombuffer(encoder(name).encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_op1(spark, small, texts):
    got = {(r.doc_id, r.start, r.end, r.class_doc_id, r.class_start, r.n_occurrences, r.removed) for r in QUERIES["op1_substring_dedup"](spark, small).collect()}
    units = {}
    for d, text in texts.items():
        for start, end, p, _ in substring_dedup.paragraphs(text):
            units[(d, start, end)] = shingle_set(p)
    root = roots_of(units, links_of(units))
    size = collections.Counter(root.values())
    assert got == {(*u, root[u][0], root[u][1], size[root[u]], u != root[u]) for u in units if size[root[u]] > 1}


def test_op1_odd(spark, odd, nothing):
    got = substring_dedup.duplicate_paragraphs(odd)
    rows = got.collect()
    assert {r.doc_id for r in rows} == {None, 5, 6} and sum(not r.removed for r in rows) == 1
    assert substring_dedup.duplicate_paragraphs(nothing).count() == 0
    cleaned = substring_dedup.without_duplicates(odd, got)
    assert cleaned.columns == odd.columns and cleaned.count() == odd.count()
    assert all("thirteen" not in r.text for r in cleaned.filter("doc_id = 6").collect())


def paragraphs_of_groups(n):
    """(doc_id, text) of n paragraphs each that are all alike, that share a few rare words alone, of some groups of alike ones, and that are equal sets."""
    rng = np.random.default_rng(5)
    some = lambda k: [f"w{x}" for x in rng.integers(0, 10**9, k)]
    core, near, parts = some(30), some(11), [some(14) for _ in range(4)]
    texts = [" ".join(core + some(1)) for _ in range(n)]
    texts += [" ".join(some(8) + near[:6] + some(8)) for _ in range(n)]
    texts += [" ".join(near[:8] + parts[i % 4] + some(1)) for i in range(n)]
    texts += [" ".join(["na"] * (12 + i)) for i in range(8)]
    texts += [" ".join(near + core[: 10 + i % 12]) for i in range(n // 4)]
    return list(enumerate(texts))


def test_op1_large_groups(spark, monkeypatch):
    """Groups of several blocks: the clusters of a brute-force version, and rows that grow with the paragraphs, not with their square."""
    dealt, plain = [], substring_dedup.verified_edges

    def counted(blocks, threshold):
        dealt[-1] += blocks.count()
        return plain(blocks, threshold)

    monkeypatch.setattr(substring_dedup, "BLOCK", 4)
    monkeypatch.setattr(substring_dedup, "verified_edges", counted)
    for n in (32, 128):
        dealt.append(0)
        texts = paragraphs_of_groups(n)
        rows = substring_dedup.duplicate_paragraphs(spark.createDataFrame(texts, "doc_id long, text string")).collect()
        units = {(d, start, end): shingle_set(p) for d, t in texts for start, end, p, _ in substring_dedup.paragraphs(t)}
        root = roots_of(units, links_of(units))
        size = collections.Counter(root.values())
        assert {(r.doc_id, r.start, r.end, r.class_doc_id, r.class_start, r.n_occurrences) for r in rows} == {(*u, root[u][0], root[u][1], size[root[u]]) for u in units if size[root[u]] > 1}
    assert 0 < dealt[1] < 6 * dealt[0]


def shared_runs(texts, n=50):
    """(key, word, key, word, length) of maximal runs of n words or more that two texts share, by brute force."""
    words, at, found = {k: WORD.findall(t or "") for k, t in texts.items()}, collections.defaultdict(list), set()
    for k, w in words.items():
        for i in range(len(w) - n + 1):
            at[tuple(w[i : i + n])].append((k, i))
    for places in at.values():
        for (a, i), (b, j) in itertools.combinations(places, 2):
            x, y = words[a], words[b]
            if a == b or (i and j and x[i - 1] == y[j - 1]):
                continue
            m = n
            while i + m < len(x) and j + m < len(y) and x[i + m] == y[j + m]:
                m += 1
            found.add((a, i, b, j, m))
    return words, found


def test_op1_shared_runs_hold_a_whole_paragraph(texts):
    """Also passages of short sentences next to a long one, hard-wrapped ones, and ones without a stop within a line."""
    rng = np.random.default_rng(3)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    short = " ".join(" ".join(some(5)) + "." for _ in range(20))
    wrapped = "\n".join(" ".join(some(8)) for _ in range(13))
    plain = " ".join(some(100))
    cases = {}
    for name, p in (("short", short), ("wrapped", wrapped), ("plain", plain)):
        for k in range(2):
            cases[f"{name}{k}"] = " ".join(some(23 + 4 * k)) + (". " if name == "short" else " ") + p + " " + " ".join(some(17 + k)) + "."
    for part, least in ((cases, 1.0), (texts, 0.9)):
        words, runs = shared_runs(part)
        spans = {}
        for k, t in part.items():
            starts = {m.start(): i for i, m in enumerate(WORD.finditer(t or ""))}
            spans[k] = {(starts[s], starts[s] + n) for s, _, _, n in substring_dedup.paragraphs(t)}
        held = [bool({(s - i, e - i) for s, e in spans[a] if i <= s and e <= i + m} & {(s - j, e - j) for s, e in spans[b] if j <= s and e <= j + m}) for a, i, b, j, m in runs]
        assert len(runs) >= 3 and sum(held) >= least * len(held)


def brute_base(text):
    found = [(m.start(), 0, m.end()) for m in secret_scan.ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def brute_dense(text, base):
    """Every run, part by part outside base spans, by marking each character."""
    free = [True] * len(text)
    for x in base.split(",") if base else []:
        _, a, b = x.split(":")
        free[int(a) : int(b)] = [False] * (int(b) - int(a))
    out, v = [], secret_scan.tiktoken_vocabulary()
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        marks = "".join("x" if free[i] else " " for i in range(m.start(), m.end()))
        for part in re.finditer("x{20,}", marks) if not secret_scan.is_known(m[0]) else []:
            a, b = m.start() + part.start(), m.start() + part.end()
            run = text[a:b]
            if not secret_scan.is_known(run) and len(run) / sum(len(v.encode_ordinary(run[i : i + 512])) for i in range(0, len(run), 512)) < 2.1:
                out.append(f"dense:{a}:{b}")
    return out


def test_op2(spark, small, texts):
    for r in QUERIES["op2_secret_scan"](spark, small).collect():
        base = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert sorted(x for x in r.spans.split(",") if x) == sorted([x for x in base.split(",") if x] + brute_dense(texts[r.doc_id], base))


def spans_in(text):
    v = secret_scan.tiktoken_vocabulary()
    base = secret_scan.base_spans(text)
    return base + secret_scan.dense_spans(text, v, secret_scan.MOST_CHARS_PER_TOKEN, base)


def test_op2_recall_and_precision():
    """Planted random strings of many alphabets are found, in any surroundings; identifiers and words are not."""
    rng = np.random.default_rng(5)
    alphabets = [string.ascii_letters + string.digits, string.ascii_letters, string.ascii_letters + string.digits + "-_", string.ascii_letters + string.digits + "+/", string.ascii_uppercase + "234567"]
    found, n = 0, 0
    for k in range(500):
        key = "".join(rng.choice(list(alphabets[k % 5]), 24 + k % 30))
        text = ["before {} after", "end of one.{} and", "x=({})", "https://a.example/{}?q", "the {}.", "https://user:{}@host.example.com/x", "https://{}.example.com/", "to {}@example.com"][k % 8 if k % 2 else 0].format(key)
        at = text.index(key)
        covered = {i for a, _, b in spans_in(text) for i in range(a, b)}
        found, n = found + (sum(i in covered for i in range(at, at + len(key))) >= 0.8 * len(key)), n + 1
    assert found >= 0.97 * n
    clean = "ISBN-978-3-16-148410-0 2024-01-02T10-11-12Z /usr/lib/x86_64-linux-gnu/libssl3 123e4567-e89b-12d3-a456-426614174000 D41D8CD98F00B204E9800998ECF8427E first.last.long.name99@mail.example.com https://a-very-long-host-name-0815.example.org/ internationalisation2024report my_very_long_variable_name_2 Donaudampfschifffahrtsgesellschaft 0049-30-1234567890-12345 counterrevolutionaries"
    assert spans_in(clean) == []


def test_op2_token_efficiency(spark):
    jwt = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkEifQ.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJVadQssw5c"
    found = {(a, b) for a, _, b in spans_in(jwt)}
    assert found == {m.span() for m in re.finditer("[^.]+", jwt)}
    key = "Zx9Qw7Lk2Vb8Nm4Jh6Tg5RqZ" + "0123456789abcdef0" + "Pq8Ws2Xe6Dc4Rf7Vt5Bg9Nh1"  # hex digits in a longer key
    assert spans_in(key) == [(24, "hex", 41), (0, "dense", 24), (41, "dense", len(key))]
    text = "key Zm9vQmFyOXg3UTJrTHA0VnRSdzhZc04z and d41d8cd98f00b204e9800998ecf8427e token=token=abcdefghijklmnop"
    r = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_dense == 1 and "dense:4:36" in r.spans and r.n_assign == 1
    clean = secret_scan.redact(spark.createDataFrame([(1, text), (2, jwt), (3, key)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert "Zm9v" not in clean[0].text and "[dense]" in clean[0].text and clean[1].text == "[dense].[dense].[dense]" and clean[2].text == "[dense][hex][dense]"


def test_op2_time_grows_with_the_text():
    import time

    rng = np.random.default_rng(1)
    text = "\n".join(f"secret = {x:040x}{'Zx9Qw7Lk2Vb8Nm4Jh6Tg' * 2}" for x in rng.integers(0, 2**62, 50_000).tolist())
    began = time.time()
    assert len(text) > 4_000_000 and len(spans_in(text)) >= 50_000
    spans_in("Q7" * 2_000_000)
    assert spans_in("ab" * 2_500_000 + " x@y.example https://a.example " + "Zx9Qw3Rt7Yp2Lk8Mn4Vb" + "@host.example")[-1][0] == 5_000_031
    assert time.time() - began < 60


def test_op2_odd(spark, odd, nothing):
    rows = secret_scan.scan(odd).collect()
    assert len(rows) == 10 and {(r.n_assign, r.spans) for r in rows if r.doc_id in (1, 2, 3, 4, 7, 9)} == {(0, "")}
    assert {r.n_assign for r in rows if r.doc_id in (None, 5, 6)} == {1}
    assert secret_scan.scan(nothing).count() == 0
    assert secret_scan.redact(odd).columns == odd.columns


def test_op3(spark, small, texts):
    sets = {d: shingle_set(t) for d, t in texts.items()}
    pairs = links_of(sets)
    links, root = collections.Counter(x for p in pairs for x in p), roots_of(sets, pairs)
    for r in QUERIES["op3_ngram_jaccard_join"](spark, small).collect():
        assert (r.class_id, r.n_links) == (root[r.doc_id], links[r.doc_id])


def test_op3_hot_group_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(60):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    rows += [(100 + i, rows[0][1]) for i in range(20)]
    sets = {d: shingle_set(t) for d, t in rows}
    links = collections.Counter(x for p in links_of(sets) for x in p)
    monkeypatch.setattr(ngram_join, "SIGNATURE_BLOCK", 16)
    monkeypatch.setattr(ngram_join, "SET_BLOCK", 8)
    got = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: links[d] for d in sets}


def test_op3_odd(spark, odd, nothing):
    got = ngram_join.near_duplicates(odd).collect()
    assert len(got) == 10
    assert {(r.class_id, r.n_links) for r in got if r.doc_id in (1, 2, 3)} == {(1, 2)}
    assert {(r.class_id, r.n_copies) for r in got if r.doc_id in (5, 6)} == {(5, 3)}
    assert ngram_join.near_duplicates(nothing).count() == 0


def test_bayes_thresholds():
    assert similar.least_matches(16, 0.8, 1e-5) <= 0.8 * 16
    for n in (16, 64, 128):  # exact posterior by integration
        m = similar.least_matches(n, 0.8, 1e-5)
        s = np.linspace(0, 1, 200001)
        for k, dropped in ((m, False), (m - 1, True)):
            f = s**k * (1 - s) ** (n - k)
            assert (f[s >= 0.8].sum() / f.sum() < 1e-5) == dropped


@pytest.mark.parametrize("name", ["op4_license_scan", "op5_source_mix"])
def test_sql(name, spark, small, duck):
    got = QUERIES[name](spark, small)
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    text = lambda rows: sorted(tuple(round(float(x), 6) if isinstance(x, (int, float)) else x for x in r) for r in rows)
    assert text(tuple(r) for r in got.select(*columns).collect()) == text(want.fetchall())


def test_op4_odd(spark, odd, nothing):
    d = odd.unionByName(odd.limit(1).selectExpr("20L AS doc_id", "'Released under the MIT License.' AS text", *[c for c in odd.columns if c not in ("doc_id", "text", "path")], "'/p/LICENSE' AS path"))
    got = {r.doc_id: r for r in license_scan.licences(d).collect()}
    assert got[20].origin == "file" and (got[6].origin, got[6].license, got[6].from_doc_id) == ("inherited", "MIT", 20)
    assert license_scan.licences(nothing).count() == 0


def test_op4_words_of_a_hot_header_and_of_small_tables(spark):
    rows = [(i, "Released under the MIT License.\nbody of " + f"x{i}", f"a/b/{i}.txt") for i in range(3)] + [(3, "something else", "a/c/3.txt"), (4, "Licensed under CC BY-NC 4.0.", "LICENSE"), (5, "nothing here", "/z/5.txt")]
    got = {r.doc_id: r for r in license_scan.licences(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert all(got[i].license == "MIT" for i in range(3)) and got[4].origin == "file"
    assert (got[3].origin, got[3].from_doc_id) == ("inherited", 4) and got[5].origin == "none"


def test_op4_whole_texts_and_common_headers(spark):
    """Sixty of a hundred files with one header, and licence texts among others: each with its own name."""
    whole = [t for n, t in license_scan.TEMPLATES if len(t) > 700]
    names = [n for n, t in license_scan.TEMPLATES if len(t) > 700]
    header = "Released under the MIT License."
    rows = [(i, f"{header}\n" + " ".join(f"v{i}w{k}" for k in range(40)), f"a/d{i}/f.c") for i in range(60)]
    rows += [(60 + i, " ".join(f"u{i}w{k}" for k in range(40)), f"b/d{i}/f.c") for i in range(40)]
    rows += [(200 + i, "Copyright (c) 2020 A. Person\n\n" + t.replace(". ", ".\n"), f"c/d{i}/LICENSE") for i, t in enumerate(whole)]
    rows += [(None, header, "d/x.c"), (None, "nothing of that kind", "d/y.c")]
    got = license_scan.licences(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all((of[i].license, of[i].origin) == ("MIT", "header") for i in range(60)) and all(of[60 + i].origin == "none" for i in range(40))
    assert [(of[200 + i].license, of[200 + i].origin) for i in range(len(whole))] == [(n, "file") for n in names]
    assert sorted(r.origin for r in got if r.doc_id is None) == ["file", "inherited"]


def test_op4_reads_templates(spark, tmp_path):
    long = {n: " ".join(f"{n}{k % 300} of the licence" for k in range(900)) for n in ("x", "y")}
    for n, t in long.items():
        (tmp_path / f"{n}.txt").write_text(t)
    more = license_scan.read_templates(spark, f"file://{tmp_path}")
    assert more == sorted(long.items())
    rows = [(1, "Some title\n" + long["x"], "p/LICENSE"), (2, long["y"], "q/LICENSE"), (3, "other words", "q/r/a.c")]
    got = {r.doc_id: r.license for r in license_scan.licences(spark.createDataFrame(rows, "doc_id long, text string, path string"), license_scan.TEMPLATES + more).collect()}
    assert got == {1: "x", 2: "y", 3: "y"}


def test_op5_targets(spark, odd, nothing):
    sizes = {"a": 100, "b": 1, "c": 50, "d": 0, None: 1000}
    rows = [(k, v) for k, v in sizes.items()]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], (3, 1, 2, 3, 1), strict=True))
    want, full, left = {}, set(), 1.5 * sum(sizes.values())
    while True:  # reshare what stops at twice the size
        share = {k: left * weights[k] / sum(w for x, w in weights.items() if x not in full) for k in weights if k not in full}
        over = {k for k, v in share.items() if v > 2 * sizes[k]}
        if not over:
            break
        full |= over
        left -= sum(2 * sizes[k] for k in over)
        want |= {k: 2 * sizes[k] for k in over}
    want |= share
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}
    m = mixing.mix(odd)
    assert m.count() == 10 and m.agg(F.max("_mix.copies")).first()[0] <= 2
    assert mixing.emit(m).columns == odd.columns and mixing.mix(nothing).count() == 0


def test_op5_rows_without_ids_and_repeated_rows_come_near_the_target(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, f"{text} {k}", "a") for k in range(400)] + [(k % 2, text, "b") for k in range(400)] + [(None, None, "c")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [mixing.mix(d).select("source", "_mix.*") for d in (docs, docs.repartition(7, "text"))]
    for g in got:
        for r in g.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most"), F.count("*").alias("n")).collect():
            assert abs(r.taken - r.target) <= 0.1 * r.target and r.most <= 2 and r.n == (30 if r.source == "c" else 400)
    assert sorted(map(repr, got[0].collect())) == sorted(map(repr, got[1].collect()))


def test_op6_round_trip(spark, small, texts, tmp_path):
    t = Tokenizer.from_file(tokenizer_path(WORD_BPE))
    at = 0
    got = {r.doc_id: r for r in QUERIES["op6_token_files"](spark, small).collect()}
    for d, text in texts.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op6_odd(spark, odd, nothing, tmp_path):
    folder = f"file://{tmp_path}/f"
    m = token_files.write_token_files(odd, folder)
    rows = token_files.read_token_files(m, folder).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 9] and bytes(rows[1].ids) == b"\2\0\0\0"
    assert [r.doc_id for r in token_files.read_token_files(m, folder, only=[6]).collect()] == [6]
    assert token_files.read_token_files(token_files.write_token_files(nothing, folder), folder).count() == 0
    import zstandard

    raw = next(tmp_path.glob("f/*.zst")).read_bytes()  # any zstandard reader can read the file
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as z:
        assert len(z.read()) % 4 == 0


def test_op6_damage_is_found(tmp_path):
    import io

    out = io.BytesIO()
    w = token_files.FrameWriter(out)
    w.add(1, b"\1\0\0\0" * 50)
    w.close()
    raw = bytearray(out.getvalue())
    raw[6] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        token_files.FrameReader(io.BytesIO(bytes(raw)), len(raw)).frame(0)


def counts(text):
    w = WORD.findall(text or "")
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def votes_of(text):
    """The rules of op7 restated over a text's own counts."""
    n, chars, symbols, dup, repeats = counts(text)
    text = (text or "").strip(" \t\n\x0b\x0c\r")
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    cat = [unicodedata.category(c) for c in text]
    upper, letters, stops = cat.count("Lu"), sum(c[0] == "L" for c in cat), sum(x[-1] in ".!?" for x in w)
    marked, different = sum(bool(re.search("[#*$%&|<>]", x)) for x in lines), sum(len(set(w[i : i + 100])) for i in range(0, n, 100))
    rules = [
        (symbols > 0.1 * n, symbols <= 0.02 * n), (letters < 0.88 * chars, letters >= 0.93 * chars), (marked > 0.3 * len(lines), marked <= 0.05 * len(lines)),
        (repeats > 0.15 * n, repeats <= 0.02 * n), (dup > 0.3 * len(lines), dup <= 0.05 * len(lines)), (upper > 0.3 * chars, upper <= 0.1 * chars),
        (different < 0.4 * n, different >= 0.6 * n), (chars < 2 * n or chars > 7 * n, 3 * n <= chars <= 6.5 * n), (stops < 0.03 * n, stops >= 0.04 * n),
    ]
    return tuple(-1 if bad else int(good) for bad, good in rules)


def fitted(patterns):
    """Probability of quality of each pattern of votes (votes -> number), by expectation-maximisation in plain Python."""
    k = len(next(iter(patterns)))
    share, good, bad = 0.8, [0.9] * k, [0.6] * k

    def q(v):
        g, b = share, 1 - share
        for j, x in enumerate(v):
            g *= {1: good[j], -1: 1 - good[j], 0: 1}[x]
            b *= {1: 1 - bad[j], -1: bad[j], 0: 1}[x]
        return g / (g + b)

    for _ in range(quality.ROUNDS):
        w = [(v, n * q(v), n * (1 - q(v))) for v, n in patterns.items()]
        new_good = [(sum(g for v, g, _ in w if v[j] == 1) + 4) / (sum(g for v, g, _ in w if v[j]) + 5) for j in range(k)]
        new_bad = [(sum(b for v, _, b in w if v[j] == -1) + 4) / (sum(b for v, _, b in w if v[j]) + 5) for j in range(k)]
        share, good, bad = (sum(g for _, g, _ in w) + 1) / (sum(g + b for _, g, b in w) + 2), new_good, new_bad
    return {v: q(v) for v in patterns}


def test_op7(spark, small, texts):
    votes = {d: votes_of(t) for d, t in texts.items()}
    posterior = fitted(collections.Counter(votes.values()))
    rows = QUERIES["op7_quality_rules"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        c = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == c
        assert r.base_failed == (c[0] < 20 or 100 * c[4] > 30 * c[0])
        assert r.kept == (not r.base_failed and posterior[votes[r.doc_id]] >= 0.5)


def test_op7_variety_does_not_depend_on_length(spark):
    """The same kind of wording is voted on alike at any length."""
    rng = random.Random(11)
    poor, rich = [f"w{i}" for i in range(30)], [f"w{i}" for i in range(3000)]
    rows = [(k, n, " ".join(rng.choice(words) for _ in range(n))) for k, words in enumerate((poor, rich)) for n in (100, 4999, 5000, 5001, 60000)]
    rule = [name for name, _, _ in quality.RULES].index("variety")
    got = quality.with_votes(spark.createDataFrame(rows, "kind int, n int, text string")).select("kind", "n", F.col("_quality.votes")[rule].alias("vote")).collect()
    assert {(r.kind, r.n): r.vote for r in got} == {(k, n): (-1, 1)[k] for k, n, _ in rows}
    assert all(votes_of(t)[rule] == (-1, 1)[k] for k, _, t in rows)


def test_op7_expectation_maximisation(spark):
    """One bad vote among good ones does not decide; several weak ones do."""
    slip, junk = (1, 1, 1, 1, -1, 1, 1, 1, 1), (0, -1, 1, 0, 0, 1, -1, -1, 0)
    patterns = {(1,) * 9: 9000, slip: 60, (-1, -1, -1, 1, 1, 1, 1, -1, -1): 400, (-1, -1, 0, -1, 1, 1, -1, -1, 1): 300, junk: 30, (1, 1, 0, 1, 0, 1, 0, 1, 0): 50}
    got = {tuple(r.votes): r.quality for r in quality.pattern_quality(spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "votes array<int>, n long")).collect()}
    assert {k: round(v, 8) for k, v in got.items()} == {k: round(v, 8) for k, v in fitted(patterns).items()}
    assert got[slip] >= 0.5 > got[junk]


def test_op7_against_labels(spark):
    """Recall and precision against given labels, which the operator does not see."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("quality IS NOT NULL")
    rows = QUERIES["op7_quality_rules"](spark, folder).join(labels, "doc_id").filter("NOT base_failed").select("quality", "kept").collect()
    junk, good = [r.kept for r in rows if r.quality == 0], [r.kept for r in rows if r.quality == 1]
    assert sum(junk) <= 0.05 * len(junk) and sum(good) >= 0.98 * len(good) and len(junk) > 10


def test_op7_odd(spark, odd, nothing):
    d = quality.judge(quality.with_votes(odd))
    assert d.columns == [*odd.columns, "_quality"] and d.count() == 10
    assert d.filter("doc_id = 4").select("_quality.n_words").first()[0] == 40000
    assert quality.judge(quality.with_votes(nothing)).count() == 0
    again = quality.with_votes(quality.with_votes(odd))
    assert again.columns == [*odd.columns, "_quality"]


def test_op8(spark, small, texts):
    t = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    rows = QUERIES["op8_best_fit_packing"](spark, small).collect()
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for d, text in texts.items():
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    check_places(rows)


def check_places(rows):
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.06 * sum(r.length for r in rows) / 1024 + 2


def test_op8_plan_is_best_fit():
    rng = np.random.default_rng(0)
    for n in (1, 20, 3000):
        lengths = np.minimum(1024, rng.lognormal(5.5, 1.2, n).astype(int) + 1)
        room, count = collections.Counter(), 0
        for x in sorted(map(int, lengths), reverse=True):  # best fit, longest first, one by one
            fit = min((r for r in room if r >= x and room[r]), default=None)
            if fit is None:
                count, fit = count + 1, 1024
            else:
                room[fit] -= 1
            room[fit - x] += 1
        runs = packing.plan_slots(collections.Counter(map(int, lengths)))
        assert len({first + i for _, _, n_, first, _ in runs for i in range(n_)}) == count


def test_op8_odd(spark, odd, nothing):
    rows = packing.pack(packing.token_pieces(odd), group_rows=3).collect()
    assert sum(r.doc_id == 5 for r in rows) == 2 and [r.length for r in rows if r.doc_id == 2] == [1]
    check_places(rows)
    assert packing.pack(packing.token_pieces(nothing)).count() == 0


def test_op9(spark, small, texts):
    ids = list(texts)
    near = []
    for r in QUERIES["op9_fingerprints"](spark, small).collect():
        text, following = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (merkle.fingerprint(text), merkle.fingerprint(changed))
        assert r.near_next == merkle.likeness(r.fingerprint, merkle.fingerprint(following)) and 0 <= r.near_edited <= 1
        near.append(r.near_edited > r.near_next)
    assert sum(near) > 0.9 * len(near)


def test_op9_locates_edits():
    text = "".join(f"This is sentence number {i} of a long text about nothing.\n" for i in range(100))
    changed = text.replace("number 50 of", "number fifty of")
    (start, end), = merkle.differing(merkle.fingerprint(text), merkle.fingerprint(changed))
    assert text[start:end] == "This is sentence number 50 of a long text about nothing.\n"
    assert 0.97 < merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(changed)) < 1


def plain_tree(text):
    """The tree by its definition: [(section, [(leaf, characters)])] and the root, from the text's sentences and lines."""
    blake = lambda data: hashlib.blake2b(data, digest_size=16).digest()
    leaves, leaf, i = [], "", 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] not in "\n.!?":
            j += 1
        while j < len(text) and text[j] in "\n.!?":
            j += 1
        leaf, i = leaf + text[i:j], j
        if len(leaf) >= 48 or leaf.endswith("\n"):
            leaves.append(leaf)
            leaf = ""
    leaves += [leaf] if leaf else []
    assert "".join(leaves) == text
    sections, open_ = [], []
    for k, leaf in enumerate(leaves):
        open_.append(leaf)
        if blake(leaf.encode())[-1] % 8 == 0 or k == len(leaves) - 1:
            sections.append((blake(b"".join(blake(x.encode()) for x in open_)), open_))
            open_ = []
    return blake(b"".join(h for h, _ in sections)).hex(), sections


def plain_likeness(a, b):
    """Both texts' characters in common leaves, by the texts of the leaves themselves."""
    x, y = (collections.Counter(leaf for _, s in plain_tree(t)[1] for leaf in s) for t in (a, b))
    return 2 * sum(len(k) * n for k, n in (x & y).items()) / (len(a) + len(b)) if a or b else 1.0


def test_op9_brute_force(spark, small, texts):
    """Fingerprints and likeness against a tree that is built from the definition and compared by its texts."""
    ids = list(texts)
    for r in QUERIES["op9_fingerprints"](spark, small).collect():
        text, following = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        for t, got in ((text, r.fingerprint), (changed, r.edited_fingerprint)):
            root, sections = plain_tree(t)
            want = ";".join(f"{h.hex()[:12]}=" + ",".join(f"{hashlib.blake2b(x.encode(), digest_size=16).hexdigest()[:10]}.{len(x)}" for x in s) for h, s in sections)
            assert got == f"{root}|{want}"
        assert abs(r.near_edited - plain_likeness(text, changed)) < 1e-9 and abs(r.near_next - plain_likeness(text, following)) < 1e-9


def test_op9_order_of_least_ids(spark):
    """A row without an id comes before that of the least id, and both keep what they are; any number of parts."""
    rows = [(None, "no id at all."), (-(2**63), "the least."), (0, "zero."), (2**63 - 1, "the most.")]
    for parts in (1, 2, 90):
        got = {r.doc_id: r.edited_sha256 for r in merkle.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), parts).collect()}
        for (i, a), (_, b) in zip(rows, rows[1:] + rows[:1], strict=True):
            assert got[i] == hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()


def test_op9_odd(spark, odd, nothing):
    rows = merkle.fingerprints(odd, parts=3).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 2, 3, 4, 5, 5, 6, 7, 9]
    same = {r.fingerprint for r in rows if r.doc_id in (5, 6)}
    assert len(same) == 1 and merkle.fingerprints(nothing).count() == 0
    assert merkle.fingerprints(odd.filter("doc_id = 7"), parts=4).first().near_next == 1


def test_op10(spark, small, texts):
    import duckdb

    t = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{small}/documents.parquet'").fetchall())
    lengths = collections.defaultdict(list)
    for d, text in texts.items():
        lengths[langs[d]].append(len(t.encode(text, add_special_tokens=False).ids))
    rows = QUERIES["op10_token_counts"](spark, small).collect()
    for r in rows:
        every = lengths[r.lang]
        assert r.n_docs == every.count(r.length) and r.docs_from == sum(x >= r.length for x in every)
        assert r.kept_tokens == sum(min(x, r.length) for x in every) and r.tokens_from == sum(x for x in every if x >= r.length)
    hist = token_counts.length_histogram(token_counts.with_token_counts(spark.read.parquet(f"{small}/documents.parquet"), ["lang"]), ["lang"])
    for r in token_counts.quantile_at(hist, 0.5, ["lang"]).collect():
        every = lengths[r.lang]
        assert r.length == max(x for x in every if sum(y < x for y in every) <= 0.5 * len(every))
    for r in token_counts.totals_at(hist, 512, ["lang"]).collect():
        assert (r.kept_tokens, r.docs_over) == (sum(min(x, 512) for x in lengths[r.lang]), sum(x > 512 for x in lengths[r.lang]))


def test_op10_odd(spark, odd, nothing):
    rows = token_counts.length_histogram(token_counts.with_token_counts(odd, ["lang"]), ["lang"]).collect()
    assert sum(r.n_docs for r in rows) == 10 and {r.lang for r in rows} == {"en", "de", "fr", None}
    assert token_counts.length_histogram(token_counts.with_token_counts(nothing, []), []).count() == 0
    named = odd.withColumn("n_docs", F.lit(1)).withColumn("n_tokens", F.lit(2)).withColumn("below", F.col("lang"))
    for keep, by, name in (("length", "length", "length_"), ("n_docs", "n_docs", "n_docs_"), ("n_tokens", "n_tokens_", "n_tokens_"), ("below", "below", "below_"), ("text", "text", "text"), ("_group", "_group", "_group"), ("lang", "n_tokens", "n_tokens_")):
        hist = token_counts.length_histogram(token_counts.with_token_counts(named, [keep]), [by])
        assert hist.columns == [name, *token_counts.MADE] and hist.agg(F.sum("n_docs")).first()[0] == 10
        assert token_counts.totals_at(hist, 5, [name]).agg(F.sum("n_docs")).first()[0] == 10


@pytest.fixture(scope="session")
def twins(spark):
    """Several rows without an id, one id for different texts, and rows that tie."""
    words = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    near = words("a").replace("a39", "other")
    rows = [(None, words("n")), (None, words("m")), (None, words("n")), (5, words("a")), (5, words("b")), (6, near), (7, words("c")), (7, words("c")), (8, words("d")), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_op3_rows_without_an_id_and_ids_of_several_texts(twins):
    got = collections.Counter((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in ngram_join.near_duplicates(twins).collect())
    assert got == collections.Counter({(None, None, 2, 1): 2, (None, None, 1, 0): 2, (5, 5, 1, 1): 1, (5, 5, 1, 0): 1, (6, 5, 1, 1): 1, (7, 7, 2, 1): 2, (8, 8, 1, 0): 1})
    left = ngram_join.one_of_each(twins).collect()
    assert len(left) == 7 and collections.Counter(r.doc_id for r in left) == {None: 3, 5: 2, 7: 1, 8: 1}


def test_op1_rows_without_an_id_and_ids_of_several_texts(twins):
    got = substring_dedup.duplicate_paragraphs(twins)
    rows = got.collect()
    assert collections.Counter(r.doc_id for r in rows if not r.removed)[7] >= 1
    by_place = collections.defaultdict(list)
    for r in rows:
        by_place[(r.class_doc_id, r.class_start)].append(r.removed)
    assert all(v.count(False) == 1 for v in by_place.values())
    assert {r.doc_id for r in rows} == {None, 5, 6, 7}
    texts = substring_dedup.without_duplicates(twins, got).collect()
    assert len(texts) == 10 and sorted(bool(r.text.strip()) for r in texts if r.doc_id == 7) == [False, True]
    assert [r.text for r in texts if r.doc_id == 8] == [" ".join(f"d{i}" for i in range(40))]
