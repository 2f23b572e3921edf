"""PII: base patterns and bootstrapped contextual extraction.

Base spans come from four fixed rules (email, ip, card, phone). They are the
seed entities of the bootstrap. Every mention that looks like an identifier (a
token with a digit or '@', seed or not) stands in a context: the word before it
with its punctuation, and its shape. A pattern is such a context; the graph
links patterns and instances (mentions by value). Spark scores it iteratively:
a pattern's confidence is the smoothed mean of its instances' trust, an
instance's trust is what its best pattern gives it (seeds keep 1, an instance
that never stood beside a trusted pattern 0), and with trust goes a kind: that
of the seed or of the best pattern; a pattern has the kind that most of its
trusted instances have, so it needs no seed of its own. A pattern of high confidence and
enough distinct instances is kept if its word is a cue: of all places where the
word stands in the corpus, at least half are followed by a mention (which rules
out words like "the"; a word joined to what follows it, as in "mail:x@y.z",
stands there too). Kept patterns add the mentions they match and that overlap no
base span; an added span has the kind of its pattern. A mention without a rule
is one token, so an identifier with inner spaces is found by the rules only. The
word before a mention counts by its last 64 characters, a shape by the first 64
of the mention and 24 signs: both only name a context, all mentions are seen.

Defined results: a null or empty text has no spans. Repeated documents are each
answered; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textops as X
from quern.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 4
MIN_CONFIDENCE, MIN_INSTANCES, SMOOTHING, MIN_CUE = 0.8, 8, 1.0, 0.5
#: The trusted patterns that redact() broadcasts, at most.
MAX_PATTERNS = 1_000_000
SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
MENTION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("pattern", pa.string()), ("value", pa.string())])
SPAN_SQL = "array<struct<start:int,end:int,kind:string>>"
MENTION_SQL = "array<struct<start:int,end:int,kind:string,pattern:string,value:string>>"

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_JOINT = re.compile(r"(?<=\W)(?!^)(?=.)|(?<=.)(?=\W)|(?<=[^\d\W])(?=\d)")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = 2 * d if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    """Leftmost matches of the email rule: each '@' with a domain, and the longest local part before it."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(token: str) -> str:
    """Runs of letters folded, runs of digits by their length: at most 24 signs."""
    return re.sub(r"[0-9]+", lambda m: f"9{len(m[0])}", re.sub(r"[^\W\d_]+", "a", token[:64]))[:24]


def mentions(text: str, base: list[tuple[int, int, int]]):
    """(start, end, kind or None, pattern, value) of every identifier-like mention."""
    found = [(a, b, KINDS[k]) for a, k, b in base]
    taken, at = sorted((a, b) for a, _, b in base), 0
    for m in _TOKEN.finditer(text) if base or "@" in text or _DIGIT.search(text) else ():
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] < m.end():
            continue
        if "@" not in m[0] and not _DIGIT.search(m[0]):
            continue
        token = m[0].strip(".,;:!?\"'()[]{}<>*&$#%")
        if token:
            start = m.start() + m[0].index(token)
            found.append((start, start + len(token), None))
    for a, b, kind in found:
        before = text[max(0, a - 64) : a].split()[-1:]  # the word before
        value = text[a:b]
        yield a, b, kind, f"{before[0].lower() if before else ''}\t{shape(value)}", value


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, base spans and mentions of every document."""

    def run(batches):
        for batch in batches:
            base_out, mention_out = [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                base = base_spans(t)
                base_out.append([{"start": a, "end": b, "kind": KINDS[k]} for a, k, b in base])
                mention_out.append([dict(zip(("start", "end", "kind", "pattern", "value"), m, strict=True)) for m in mentions(t, base)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base_out, pa.list_(SPAN)), pa.array(mention_out, pa.list_(MENTION))], names=["doc_id", "base", "mentions"])

    rows = docs.select("doc_id", "text").mapInArrow(X.tidy(run), f"doc_id long, base {SPAN_SQL}, mentions {MENTION_SQL}")
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()))


def trusted_patterns(docs: DataFrame, scanned: DataFrame, rounds: int = ROUNDS, confidence: float = MIN_CONFIDENCE, instances: int = MIN_INSTANCES) -> DataFrame:
    """(pattern, kind, confidence): the bootstrap over the pattern-instance graph."""
    seen = scanned.select(F.explode("mentions").alias("m")).select("m.pattern", F.xxhash64("m.value").alias("instance"), "m.kind")
    edges = seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    # patterns of one instance decide nothing; those that could pass are few
    wide = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= instances)
    edges = materialise(edges.join(wide, "pattern"))
    trust = edges.groupBy("instance").agg(F.max(F.col("kind").isNotNull().cast("double")).alias("trust"), F.max("kind").alias("carried"))

    def score(trust: DataFrame) -> DataFrame:
        """(pattern, confidence, given): given is the kind that most trusted instances carry."""
        voted = edges.join(trust, "instance").groupBy("pattern", "carried").agg(F.sum("trust").alias("trust"), F.count("*").alias("rows"))
        best = F.max_by("carried", F.when(F.col("carried").isNotNull(), F.struct("trust", "carried")))
        return voted.groupBy("pattern").agg((F.sum("trust") / (F.sum("rows") + SMOOTHING)).alias("confidence"), best.alias("given"))

    for _ in range(rounds):
        own = F.col("kind").isNotNull()
        passed = F.when(F.col("confidence") >= confidence, F.col("confidence")).otherwise(0.0)
        spread = edges.join(score(trust), "pattern").select("instance", F.when(own, 1.0).otherwise(passed).alias("trust"), F.when(own, F.col("kind")).when(passed > 0, F.col("given")).alias("carried"))
        trust = materialise(spread.groupBy("instance").agg(F.max(F.struct("trust", "carried")).alias("best")).select("instance", "best.trust", "best.carried"))
    good = materialise(score(trust).where((F.col("confidence") >= confidence) & F.col("given").isNotNull()).select("pattern", F.col("given").alias("kind"), "confidence", _word("pattern").alias("word")))
    return good.join(_cues(docs, seen, good.select("word").distinct()), "word").select("pattern", "kind", "confidence")


def _word(pattern: str):
    return F.element_at(F.split(pattern, "\t"), 1)


def _heads(token: str):
    """The token, and what of it can stand joined before a mention."""
    yield token
    for m in _JOINT.finditer(token) if not token.isalpha() else ():
        yield token[: m.start()]


def _cues(docs: DataFrame, seen: DataFrame, words: DataFrame) -> DataFrame:
    """Those of the words that a mention follows in at least MIN_CUE of their places in all texts."""
    known = words.count()
    if known > MAX_PATTERNS:
        raise ValueError(f"{known} words stand before trusted patterns; raise MIN_INSTANCES or MIN_CONFIDENCE")
    shared = docs.sparkSession.sparkContext.broadcast({r[0] for r in words.toLocalIterator() if r[0]})

    def run(batches):
        for batch in batches:
            counts = Counter(w for t in batch.column(0) for token in (t.as_py() or "").lower().split() for w in _heads(token) if w in shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    if not shared.value:
        return words.limit(0)
    all_places = docs.select(F.col("text").cast("string")).mapInArrow(X.tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    followed = seen.select(_word("pattern").alias("word")).groupBy("word").agg(F.count("*").alias("followed"))
    return all_places.join(followed, "word").where(F.col("followed") >= MIN_CUE * F.col("n")).select("word")


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (spans by the rules) and spans (base and added ones), both by start, then kind as listed."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scanned = scan(docs)
    patterns = trusted_patterns(docs, scanned)
    open_ones = scanned.select("row", F.explode("mentions").alias("m")).where("m.kind is null").select("row", "m.pattern", "m.start", "m.end")
    added = open_ones.join(patterns, "pattern").groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("added"))
    order = "case kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
    both = F.concat("base", F.coalesce("added", F.array().cast(SPAN_SQL)))
    ranked = F.expr(f"transform(_all, x -> struct(x.start as start, {order.replace('kind ', 'x.kind ', 1)} as rank, x.end as end, x.kind as kind))")
    joined = scanned.select("row", "doc_id", "base").join(added, "row", "left").withColumn("_all", both).withColumn("_all", F.array_sort(ranked))
    return joined.select("doc_id", "base", F.expr("transform(_all, x -> struct(x.start as start, x.end as end, x.kind as kind))").alias("spans"))


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """docs with each span replaced by its kind in brackets; other columns stay (length follows the text)."""
    at, size = docs.columns.index(text), docs.columns.index(length) if length in docs.columns else None
    texts_only = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = materialise(trusted_patterns(texts_only, scan(texts_only)).select("pattern", "kind"))
    known = found.count()
    if known > MAX_PATTERNS:
        raise ValueError(f"{known} patterns were trusted; raise MIN_INSTANCES or MIN_CONFIDENCE")
    shared = docs.sparkSession.sparkContext.broadcast(dict(found.toLocalIterator()))

    def run(batches):
        for batch in batches:
            texts = []
            for value in batch.column(at):
                value = value.as_py()
                if value:
                    base = base_spans(value)
                    spans = [(a, b, k) for a, b, kind, p, _ in mentions(value, base) if (k := kind or shared.value.get(p))]
                    done, parts = 0, []
                    for a, b, k in sorted(spans):
                        if b > done:
                            parts += [value[done:a], f"[{k.upper()}]"] if a >= done else []
                            done = b
                    value = "".join([*parts, value[done:]]) if parts else value
                texts.append(value)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if size is not None:
                old = columns[size].to_pylist()
                columns[size] = pa.array([len(t) if t is not None else n for t, n in zip(texts, old, strict=True)], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(X.tidy(run), docs.schema)

