"""Operator 3: secret scans behind a trigram index.

From each rule's parsed regular expression a Boolean query over trigrams is derived: what every match must contain.  Texts
are taken in blocks; a block's inverted index maps each trigram that some rule asks for to its posting list of documents,
with ASCII letters folded.  A rule's candidates are the documents that its query leaves after intersecting and uniting
postings; only they are verified with the expression itself.  (`build_index` keeps an index of all trigrams of a corpus as a
table, for rules that come later: `find` reads the postings that they ask for and nothing else of it.)  A rule whose query is empty (no mandatory trigram, such as
a run of hex digits) scans every document.  Blocks are built, used and dropped within a task: no shuffle, bounded memory,
and a lost executor costs the blocks it was at.

Spans are in code points, end exclusive; per rule they are leftmost and do not overlap; rules may overlap each other.

Defined results: a null text counts as empty and has no spans; repeated rows give repeated results; a null doc_id is kept.
`redact` passes all other columns through, whatever their names; `scan` reads only doc_id and text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C  # noqa: N812
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20
MOST_STRINGS = 64  #: alternatives that are spelled out while a query is derived


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the part whose length counts
    at_least: int = 0  # code points of that part; shorter matches are dropped


#: A private key from BEGIN through END, whatever lies between them but another BEGIN or END.  Where that END is missing: the
#: header and the key lines after it, real line breaks or written as \\n, quoted or indented; a run of 16 or more is a key's,
#: a shorter one only if it is padded or has its line to itself.
_KEY_NAME = r"[A-Z0-9 ]*PRIVATE\x20KEY(?:\x20BLOCK)?-----"
_KEY_TO_END = rf"(?:[^-]++|-(?!----(?:BEGIN|END)\x20))*+-----END\x20{_KEY_NAME}"
_KEY_BREAK = r"(?:\r\n|[\r\n]|\\r\\n|\\[rn])"
_KEY_FIELD = rf"{_KEY_BREAK}[ \t>|#*\"']*(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset|MessageID):(?:(?!\\[rn])[^\r\n])*+"
_KEY_LONG = r"(?:\\[rnt]|[\s\"'`>|#*,;\\]|\+(?=\s))*+(?:[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]{1,15}={1,2}(?![^\s\"'\\]))"
_KEY_SHORT = rf"{_KEY_BREAK}[ \t>|#*\"']*=?[A-Za-z0-9+/]{{1,15}}={{0,2}}(?=[ \t\"']*(?:[\r\n]|\\[rn]|\Z))"
_PRIVATE_KEY = rf"-----BEGIN\x20{_KEY_NAME}(?:{_KEY_TO_END}|(?:{_KEY_FIELD})*+(?:{_KEY_LONG}|{_KEY_SHORT})*+)"

#: The first three fix the base spans; the others add spans of published token formats.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # the runs of [0-9a-f]+ that have 32 or more
    Rule("private_key", _PRIVATE_KEY),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay_key", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    # The scheme is the whole run before ://, so each run is read once; user and password end at signs they can't hold.
    Rule("url_login", r"(?<![a-z0-9+.-])[a-z0-9+.-]++://[^\s/:@]*+:[^\s/:@]++@"),
)
BASE = ("assign", "access", "hex")

#: A query is None (anything), a trigram (bytes), or ("and" | "or", frozenset of queries).
Query = object


def both(parts: Sequence[Query]) -> Query:
    kept = frozenset(x for x in parts if x is not None)
    return None if not kept else next(iter(kept)) if len(kept) == 1 else ("and", kept)


def either(parts: Sequence[Query]) -> Query:
    kept = frozenset(parts)
    return None if None in kept or not kept else next(iter(kept)) if len(kept) == 1 else ("or", kept)


def fold(text: str) -> bytes:
    return text.encode().lower()


def of_strings(strings: set[str]) -> Query:
    def one(s: str) -> Query:
        raw = fold(s)
        return both([raw[i : i + 3] for i in range(len(raw) - 2)])

    return either([one(s) for s in strings])


REPEATS = (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT)


def analyse(items: Sequence) -> tuple[set[str] | None, Query]:
    """Of a sequence of parsed items: the strings it can be if they are few, and a query that all its matches meet."""
    now: set[str] = {""}
    parts: list[Query] = []
    exact = True

    def flush() -> None:
        nonlocal now, exact
        parts.append(of_strings(now))
        now, exact = {""}, False

    for op, arg in items:
        strings, query = one_item(op, arg)
        if op in REPEATS and strings is None and arg[0] == 1 and (body := analyse(arg[2])[0]) and len(now) * len(body) <= MOST_STRINGS:
            now = {a + b for a in now for b in body}  # the first of the repeated ends this run, the last of them begins the next
            flush()
            now = body
        elif strings is not None and len(now) * len(strings) <= MOST_STRINGS:
            now = {a + b for a in now for b in strings}
        else:
            flush()
            if strings is not None:
                now = strings
            else:
                parts.append(query)
    if exact:
        return now, of_strings(now)
    parts.append(of_strings(now))
    return None, both(parts)


def one_item(op: object, arg: object) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {chr(arg)}, None
    if op is C.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                chars.add(chr(x))
            elif kind is C.RANGE and x[1] - x[0] < 8:
                chars |= {chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= 8 else (None, None)
    if op is C.SUBPATTERN:
        return analyse(arg[-1])
    if op is C.BRANCH:
        found = [analyse(x) for x in arg[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= MOST_STRINGS:
            return set().union(*(s for s, _ in found)), None
        return None, either([q for _, q in found])
    if op in REPEATS:
        low, high, body = arg
        strings, query = analyse(body)
        if strings is not None and (low, high) == (0, 1):
            return strings | {""}, None
        if strings is not None and low == high and len(strings) ** low <= MOST_STRINGS:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in strings}
            return out, None
        return None, query if low else None
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}, None
    return None, None


def trigram_query(pattern: str) -> Query:
    return analyse(_parser.parse(pattern, re.ASCII))[1]


def trigrams(query: Query) -> set[bytes]:
    return set() if query is None else {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


class Scanner:
    """The rules, their queries and the trigrams that they ask for."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        grams = sorted(set().union(*(trigrams(q) for _, _, q in self.rules)))
        self.slots = {g: k + 1 for k, g in enumerate(grams)}
        self.slot_of = np.zeros(1 << 24, np.uint16)
        for g, k in self.slots.items():
            self.slot_of[int.from_bytes(g, "big")] = k
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def index(self, data: np.ndarray, at: np.ndarray) -> dict[int, np.ndarray]:
        """Postings of a block: slot -> documents (ascending).  data: the texts' bytes, at: where each begins, and the end."""
        if len(data) < 3:
            return {}
        low = self.lower[data].astype(np.uint32)
        slot = self.slot_of[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        pos = np.flatnonzero(slot)
        doc = np.searchsorted(at, pos, side="right") - 1
        inside = pos + 2 < at[doc + 1]
        pairs = np.unique(slot[pos[inside]].astype(np.int64) << 32 | doc[inside])
        slots, first = np.unique(pairs >> 32, return_index=True)
        return {int(s): x & 0xFFFFFFFF for s, x in zip(slots, np.split(pairs, first[1:]), strict=True)} if len(pairs) else {}

    def candidates(self, query: Query, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
        if query is None:
            return np.arange(n)
        if isinstance(query, bytes):
            return postings.get(self.slots[query], np.zeros(0, np.int64))
        found = sorted((self.candidates(q, postings, n) for q in query[1]), key=len)
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out

    def block(self, texts: Sequence[str], data: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, kind) of each text, by start and then in the rules' order."""
        postings = self.index(data, at)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, regex, query) in enumerate(self.rules):
            for d in self.candidates(query, postings, len(texts)):
                for m in regex.finditer(texts[d]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.at_least:
                        spans[d].append((m.start(), k, m.end()))
        return [[(s, e, self.rules[k][0].kind) for s, k, e in sorted(x)] for x in spans]

    def texts(self, column: pa.Array) -> Iterator[tuple[list[str], list[list[tuple[int, int, str]]]]]:
        """Block by block: the texts and their spans."""
        for lo, hi, data, at in blocks_of(column):
            texts = [x or "" for x in column.slice(lo, hi - lo).to_pylist()]
            yield texts, self.block(texts, data, at)


def blocks_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about BLOCK_BYTES: first row, row after the last, their bytes, and where each begins (and the end)."""
    raw = column.fill_null("").cast(pa.large_binary())
    if not len(raw):
        return
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(raw):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK_BYTES, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans (array of kind, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in x] for _, block in scanner(rules).texts(batch.column("text")) for x in block]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, SPANS)], ["doc_id", "spans"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long>>")


POSTINGS = "gram int, docs array<long>"


def build_index(docs: DataFrame, path: str) -> None:
    """Writes the postings of all trigrams of docs (doc_id, not null, and text): a row a trigram and block of texts, sorted by
    trigram within a file, so that a reader's filter on trigrams prunes row groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = scanner(()).lower
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, data, at in blocks_of(batch.column("text")):
                low = lower[data].astype(np.int64)
                gram = low[:-2] << 16 | low[1:-1] << 8 | low[2:] if len(low) > 2 else low[:0]
                pos = np.arange(len(gram))
                doc = np.searchsorted(at, pos, side="right") - 1
                inside = pos + 2 < at[doc + 1]
                pairs = np.unique(gram[inside] << 32 | doc[inside])
                grams, first = np.unique(pairs >> 32, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([first, [len(pairs)]]), pa.int32()), pa.array(ids[lo:hi][pairs & 0xFFFFFFFF], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(grams.astype(np.int32)), lists], ["gram", "docs"])

    picked = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked.mapInArrow(run, POSTINGS).sortWithinPartitions("gram").write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(path)


def meets(query: Query, held: Column) -> Column:
    """Whether the trigrams held (an array of numbers) meet a query."""
    if query is None:
        return F.lit(True)
    if isinstance(query, bytes):
        return F.array_contains(held, int.from_bytes(query, "big"))
    parts = [meets(q, held) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def find(docs: DataFrame, path: str, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id and spans of the documents in which some rule is found, by way of the index at path.

    Postings are united by document into the few trigrams that the rules ask for; only documents that meet a rule's query
    are read and verified, and those without a doc_id, which the index can't name.  A rule without mandatory trigrams reads
    them all."""
    spark, queries = docs.sparkSession, [trigram_query(r.pattern) for r in rules]
    if None not in queries:
        wanted = sorted(int.from_bytes(g, "big") for g in set().union(*map(trigrams, queries)))
        postings = spark.read.schema(POSTINGS).parquet(path).where(F.col("gram").isin(*wanted))
        held = postings.select("gram", F.explode("docs").alias("doc_id")).groupBy("doc_id").agg(F.collect_set("gram").alias("held"))
        met = held.where(meets(either(queries), F.col("held"))).select(F.col("doc_id").alias("met"))
        narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        docs = narrow.join(met, narrow.doc_id == met.met, "left_semi").unionByName(narrow.where("doc_id is null"))
    return scan(docs, rules).where(F.size("spans") > 0)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as a string."""
    found = scan(docs)
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *map(of, BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def cut_out(text: str, spans: Sequence[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with each run of overlapping or touching spans replaced by the mark."""
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start > at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret in `text` replaced; an integer `n_chars`, if there is one, follows.  A null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, done = batch.column("text"), []
            for texts, spans in scanner(rules).texts(old):
                done += [cut_out(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            done = [t if there else None for there, t in zip(old.is_valid().to_pylist(), done, strict=True)]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": pa.array(done, old.type)}
            if "n_chars" in columns:
                sizes = zip(old.to_pylist(), done, columns["n_chars"].to_pylist(), strict=True)
                columns["n_chars"] = pa.array([n if a == b else len(b) for a, b, n in sizes], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
