"""Personal data: base patterns, and contextual extraction bootstrapped from what they find.

Base kinds (email, ip, card, phone) are found in whole texts, leftmost and non-overlapping per kind; candidates that fail their
test are dropped without retries. The scans are linear in the text, which is never cut.

Bootstrapping: base finds are the seeds. A lexical pattern is what stands around an instance: the two words before it, or the
word before and the word after (lower-cased, without signs at their edges unless they are nothing else). What stands between an instance
and the next one, or the end, of its own word counts as a word. Instances are seeds and other identifier-like words (a digit or @ in them, four
characters at least). On the graph of patterns and instances Spark repeats: a pattern's confidence in a kind is the mean
confidence of its distinct instances, with PRIOR instances of confidence zero added; an instance's is the highest of its
patterns'; seeds stay at 1. Patterns seen with SEEDS seeds or more and of confidence CONFIDENT at the end mark their unseen
instances as that kind, where they don't overlap a base span. These instances are then seeds too, at their confidence, and the
rounds are repeated on the whole graph until no pattern is added. Tallies are aggregates: a pattern or identifier that a third of
all rows hold is one row in them.

Null text counts as empty. Null doc_id: found like any other. Repeated rows are each returned, and each get the same spans. Texts of any
length are read whole. An instance that patterns of one confidence claim for several kinds is of the first of these. An empty table gives
an empty result. find() ignores columns other than doc_id and text; redact() keeps them, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import discard, prepare, scratch, stored, table, unused

KINDS = ("email", "ip", "card", "phone")
ROUNDS, PRIOR, SEEDS, CONFIDENT = 3, 1.0, 4, 0.75

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MAIL = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LIKE = re.compile(r"[0-9@]")
_EDGE = "\"'.,;:!?()[]{}<>=#*$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _MAIL.match(text, at)):
            done = m.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def phones(text: str):
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(s, 3, e) for s, e in phones(text)]
    return sorted(out)


def _hash(*parts) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), 0) - 2**63


def _context(word: str) -> int:
    """The hash of a word as a context."""
    word = word.lower()
    return _hash(word.strip(_EDGE) or word)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint intervals that cover the same positions; spans are sorted."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and identifier-like words with their patterns."""
    if not base and not _LIKE.search(text):
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    taken, i = _merged([(s, e) for s, _, e in base]), 0
    found = [(s, e, k) for s, k, e in base]
    for first, last in words:
        word = text[first:last]
        if not _LIKE.search(word):
            continue
        core = word.strip(_EDGE)
        start = first + word.find(core)
        end = start + len(core)
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if len(core) >= 4 and _LIKE.search(core) and not (i < len(taken) and taken[i][0] < end):
            found.append((start, end, -1))
    found.sort()
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    whole: dict[int, int] = {}

    def context(n: int) -> list[int]:
        if not 0 <= n < len(words):
            return []
        if n not in whole:
            whole[n] = _context(text[starts[n] : ends[n]])
        return [whole[n]]

    out, reach = [], 0  # reach: the end of all instances so far
    for n, (start, end, kind) in enumerate(found):
        here, there = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
        piece = text[max(reach, starts[here]) : start]
        left = ([_context(piece)] if piece else []) + context(here - 1)
        if len(left) < 2:
            left += context(here - 2)
        limit = found[n + 1][0] if n + 1 < len(found) else len(text)
        piece = text[end : max(end, min(limit, ends[there]))]
        right = [_context(piece)] if piece else context(there + 1)
        pats = [_hash("ll", left[1], left[0])] if len(left) >= 2 else []
        if left and right:
            pats.append(_hash("lr", left[0], right[0]))
        out.append({"start": start, "end": end, "kind": kind, "item": _hash("i", text[start:end]), "pats": pats})
        reach = max(reach, end)
    return out


_MENTION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("item", pa.int64()), ("pats", pa.list_(pa.int64()))])
_FOUND_SQL = "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, sha binary, base array<struct<start:int,kind:int,end:int>>, seen array<struct<start:int,end:int,kind:int,item:long,pats:array<long>>>"


def _scan(batches):
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 36
    for batch in batches:
        cols: list[list] = [[] for _ in range(10)]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            base = base_spans(text)
            listed = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
            values = [doc_id, number, *(sum(x[1] == k for x in base) for k in range(4)), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), [{"start": s, "kind": k, "end": e} for s, k, e in base], mentions(text, base)]
            number += 1
            for c, v in zip(cols, values, strict=True):
                c.append(v)
        types = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])), pa.list_(_MENTION)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "sha", "base", "seen"])


def bootstrap(seen: DataFrame) -> DataFrame:
    """pat, kind: patterns to trust. seen: pat, item, kind (-1: not a seed), distinct."""
    graph = stored(seen.groupBy("pat", "item").agg(F.max("kind").alias("kind")), "pii-graph")
    size = stored(graph.groupBy("pat").agg(F.count("*").alias("n")), "pii-size")
    seeds = graph.where("kind >= 0").select("pat", "item", "kind", F.lit(1.0).alias("conf"))
    trusted = found = None
    while True:
        # Confident instances are seeds of the next hop, at their confidence; a hop that trusts no further pattern ends the search.
        edges = graph.where("kind < 0").select("pat", "item")
        known, rest = (seeds, edges) if found is None else (seeds.unionByName(edges.join(found, "item").select("pat", "item", "kind", "conf")), edges.join(found, "item", "left_anti"))
        base = stored(known.groupBy("pat", "kind").agg(F.count("*").alias("seeds"), F.sum("conf").alias("held")).join(size, "pat"), "pii-seeds")
        sure = _trusted(base, stored(rest.join(base.select("pat").distinct(), "pat", "left_semi"), "pii-open"))
        sure = stored(sure if trusted is None else sure.join(trusted, "pat", "left_anti"), "pii-sure")
        if not sure.take(1):
            break
        fresh = rest.join(sure, "pat").groupBy("item").agg(F.max(F.struct("conf", (-F.col("kind")).alias("k"))).alias("best"))
        fresh = stored(fresh.select("item", (-F.col("best.k")).alias("kind"), F.col("best.conf").alias("conf")), "pii-found")
        trusted = stored(sure if trusted is None else trusted.unionByName(sure), "pii-trusted")
        discard(base)
        if not fresh.take(1):
            break
        found = stored(fresh if found is None else found.unionByName(fresh), "pii-found")
    discard(size)
    return (sure if trusted is None else trusted).select("pat", "kind")


def _trusted(base: DataFrame, open_: DataFrame) -> DataFrame:
    """pat, kind, conf: the patterns of base (pat, kind, seeds, held: their sum, n) to trust. open_: pat, item of instances that aren't seeds."""
    score = stored(base.select("pat", "kind", (F.col("held") / (F.col("n") + PRIOR)).alias("conf")), "pii-score")
    for _ in range(ROUNDS):
        last = score
        items = stored(open_.join(score, "pat").groupBy("item", "kind").agg(F.max("conf").alias("conf")), "pii-items")
        gain = open_.join(items, "item").groupBy("pat", "kind").agg(F.sum("conf").alias("more"))
        gain = stored(gain, "pii-gain")
        both = base.join(gain, ["pat", "kind"], "left")
        score = stored(both.select("pat", "kind", ((F.col("held") + F.coalesce("more", F.lit(0.0))) / (F.col("n") + PRIOR)).alias("conf")), "pii-score")
        discard(items, gain, last)
    sure = base.select("pat", "kind", "seeds").join(score, ["pat", "kind"]).where((F.col("seeds") >= SEEDS) & (F.col("conf") >= CONFIDENT))
    return sure.groupBy("pat").agg(F.max(F.struct("conf", (-F.col("kind")).alias("k"))).alias("best")).select("pat", (-F.col("best.k")).alias("kind"), F.col("best.conf").alias("conf"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_email, n_ip, n_card, n_phone, base_sha256, sha (of the text), found (array of start, kind, end): one row for each row of docs."""
    prepare(docs.sparkSession)
    with scratch():
        scanned = stored(_scanned(docs), "pii-scan", keep=True)
        extra = stored(_contextual(scanned), "pii-extra", keep=True)
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    found = F.array_sort(F.concat("base", F.coalesce("extra", none)))
    return scanned.drop("seen").join(extra, "row", "left").withColumn("found", found).drop("base", "extra")


def _scanned(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, _FOUND_SQL)


def _contextual(scanned: DataFrame) -> DataFrame:
    """row, extra: the contextual spans of the rows that have some."""
    each = scanned.select("row", F.explode("seen").alias("m")).select("row", "m.*").select("row", "start", "end", "kind", "item", F.explode("pats").alias("pat"))
    trusted = stored(bootstrap(each.select("pat", "item", "kind")), "pii-trusted")
    fresh = each.where("kind < 0").select("row", "start", "end", "pat").join(trusted, "pat")
    return fresh.groupBy("row", "start", "end").agg(F.min("kind").alias("kind")).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("extra"))


def _listed(found: str) -> F.Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"concat_ws(',', transform({found}, x -> concat(array({names})[x.kind], ':', x.start, ':', x.end)))")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets and n_chars (if there) set anew; same columns."""
    prepare(docs.sparkSession)
    # Base spans are found again where they are replaced; only contextual ones travel. Documents join these by id and by the text's SHA-256, so
    # equal rows get equal spans and no document another's.
    with scratch():
        scanned = stored(_scanned(docs), "pii-scan")
        held = scanned.select("row", "doc_id", "sha").join(stored(_contextual(scanned), "pii-extra"), "row").groupBy("doc_id", "sha").agg(F.first("extra").alias("extra"))
        spans = stored(held, "pii-spans", keep=True)
    id_, sha, found = (unused(docs, c) for c in ("own_id", "own_sha", "found"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns({id_: F.col("doc_id").cast("long"), sha: F.unhex(F.sha2(text, 256))})
    spans = spans.toDF("span_id", "span_sha", "span_found")
    same = F.col(f"d.{sha}").eqNullSafe(F.col("s.span_sha")) & F.col(f"d.{id_}").eqNullSafe(F.col("s.span_id"))
    joined = keyed.alias("d").join(spans.alias("s"), same, "left").select(*(F.col(f"d.`{c}`") for c in docs.columns), F.col("s.span_found").alias(found))

    def run(batches):
        names = [f"[{k.upper()}]" for k in KINDS]
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for text, extra in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if spans := sorted([{"start": s, "kind": k, "end": e} for s, k, e in base_spans(text or "")] + list(extra or ()), key=lambda x: (x["start"], x["kind"], x["end"])):
                    out, done = [], 0
                    for s in spans:
                        if s["start"] >= done:
                            out += [text[done : s["start"]], names[s["kind"]]]
                        done = max(done, s["end"])
                    text = "".join(out) + text[done:]
                texts.append(text)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    clean = joined.mapInArrow(run, docs.schema)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", _listed("found").alias("spans"))
