"""Secret scans by token efficiency.

Known forms (assignments, access keys, hex runs) are found by pattern.  The method adds what no
pattern names: runs that a language vocabulary encodes badly.  Words get several characters per token;
random strings get few.  Known digests and identifiers (UUIDs, book numbers, times, numbers, names and paths
made of short parts) are left out.  Hosts, e-mail addresses and what stands before their @ are runs like others: words pass, random ones do not.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.llm.common import documents, kept

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Runs of fewer characters a token than this are taken for random.
MOST_CHARS_PER_TOKEN = 2.1
#: Shorter runs say too little.
LEAST_CHARS = 20
#: Runs whose pieces between /, _, - and = are all shorter are names or paths.
LEAST_PIECE = 10
#: Longer runs are encoded in slices, so that time grows with the text alone.
SLICE_CHARS = 512

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_IDENTIFIER = re.compile(r"[0-9+/_=-]+|(?:ISBN|ISSN|isbn|issn)(?:-1[03])?[-_=]*[0-9Xx-]+|[0-9]{4}-?[0-9]{2}-?[0-9]{2}[Tt_-]?[0-9-]+(?:[Zz]|[+-][0-9]+)?")
KINDS = ("assign", "access", "hex", "dense")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the known forms, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    for run in _RUN.finditer(text):  # a long enough access key or hex run lies within such a run
        s, at = run[0], run.start()
        if "AKIA" in s:
            found += [(at + m.start(), "access", at + m.end()) for m in _ACCESS.finditer(s) if len(m[0]) >= 18]
        found += [(at + m.start(), "hex", at + m.end()) for m in _HEX.finditer(s) if len(m[0]) >= 16]
    return found


def is_known(run: str) -> bool:
    """Whether a run is a known digest or identifier, or a name or path made of short parts."""
    return bool(_DIGEST.fullmatch(run) or _UUID.fullmatch(run) or _IDENTIFIER.fullmatch(run)) or max(map(len, re.split("[/_=-]", run))) < LEAST_PIECE


def outside(start: int, end: int, taken: list[tuple[int, int]], at: int) -> tuple[list[tuple[int, int]], int]:
    """Parts of start to end that none of the `taken` spans cover, which are disjoint and sorted; at: the first of them to look at."""
    while at < len(taken) and taken[at][1] <= start:
        at += 1
    parts, k = [], at
    while k < len(taken) and taken[k][0] < end:
        if taken[k][0] > start:
            parts.append((start, taken[k][0]))
        start, k = max(start, taken[k][1]), k + 1
    if start < end:
        parts.append((start, end))
    return parts, at


def disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def n_tokens(run: str, vocabulary) -> int:
    return sum(len(vocabulary.encode_ordinary(run[i : i + SLICE_CHARS])) for i in range(0, len(run), SLICE_CHARS))


def dense_spans(text: str, vocabulary, most: float, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Parts of runs, outside the spans found already, that have few characters a token.

    Both lists are walked once, so time grows with the text.
    """
    found, taken, at = [], None, 0
    for m in _RUN.finditer(text):
        if len(m[0]) < LEAST_CHARS or is_known(m[0]):
            continue
        if taken is None:
            taken = disjoint([(a, b) for a, _, b in base])
        parts, at = outside(m.start(), m.end(), taken, at)
        for a, b in parts:
            part = text[a:b]
            if b - a >= LEAST_CHARS and (part == m[0] or not is_known(part)) and b - a < most * n_tokens(part, vocabulary):
                found.append((a, "dense", b))
    return found


def in_order(spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in in_order(spans))


def tiktoken_vocabulary(name_or_path: str = VOCABULARY):
    """A tiktoken encoding from a file of ranks, once per Python worker."""

    def read():
        import public_tokenizers
        import tiktoken

        from codicil.llm.tokens import tokenizer_path

        with open(tokenizer_path(name_or_path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return kept(("vocabulary", name_or_path), read)


def redacted(text: str, spans: list[tuple[int, str, int]], mark: str) -> str:
    out, at = [], 0
    for start, kind, end in in_order(spans):
        if end <= at:
            continue
        out.append(text[at : max(at, start)])
        if start >= at:
            out.append(mark.format(kind))
        at = end
    return "".join(out) + text[at:]


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, most: float = MOST_CHARS_PER_TOKEN) -> DataFrame:
    """doc_id, counts per kind, base_sha256, spans and n_dense for each row of docs.

    Spans are kind:start:end in code points.  Null texts count as empty: no spans, the digest of "".  Very long
    texts are read whole, in time that grows with their length.  Repeated rows give repeated results, and equal
    texts equal ones; an empty table gives none.  Other columns, whatever their names, are not read.
    """

    def rows(batches):
        v = tiktoken_vocabulary(vocabulary)
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                dense = dense_spans(text, v, most, base)
                n = [sum(k == kind for _, k, _ in base) for kind in KINDS[:3]]
                out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + dense), len(dense)))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns, types)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_dense"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_dense long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)


def redact(docs: DataFrame, mark: str = "[{}]", vocabulary: str = VOCABULARY, most: float = MOST_CHARS_PER_TOKEN) -> DataFrame:
    """docs with every span of `text` replaced by the mark; null texts stay null and other columns as they are.

    Where spans overlap, the first is marked and what the next has beyond it goes too.  Empty texts stay empty,
    long ones are read whole, repeated rows stay, an empty table gives none.
    """
    at = docs.columns.index("text")

    def rows(batches):
        v = tiktoken_vocabulary(vocabulary)
        for b in batches:
            texts = []
            for text in b.column(at).to_pylist():
                if text:
                    base = base_spans(text)
                    text = redacted(text, base + dense_spans(text, v, most, base), mark)
                texts.append(text)
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(rows, docs.schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
