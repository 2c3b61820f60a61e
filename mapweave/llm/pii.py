"""Personal data by patterns, and terms that give it away by information theory, in Spark's own functions only.

Base spans are the e-mail addresses, IPv4 addresses, card numbers and phone numbers of a text: leftmost non-overlapping
matches of a fixed pattern for each kind, of which those that fail a check (parts up to 255, Luhn, number of digits) are
dropped. The patterns here find the same matches in time proportional to the text: they only start where a match can
start, and take runs possessively.

Sanitisation adds terms: the lines that hold a base span are contexts of its value (the protected entity). Over all lines
of the corpus, PMI(term; entity) = log(n(term, entity) * lines / (n(term) * n(entity))), against the entity's own information
log(lines / n(entity)), says how much of the entity a term reveals. A term that reveals at least ``generalise_at`` of it is
generalised in the entity's lines (replaced by its kind), and from ``remove_at`` on removed. Every value and term is judged,
those seen once too: in fewer than ``support`` different lines the joint count is an estimate, and its lower bound
n(term, entity) * different / support is taken instead (copies of one line are no evidence). So a term and a value that only
ever meet in one line are told from chance if the corpus has more than some forty lines for each line of the value.

Null and empty texts have no spans; equal rows have equal spans; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import let, materialize

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
PATTERNS = {
    # \G: a match may also begin where the last one ended
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's pattern to be worth trying.
HINTS = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"(?:[0-9][\x20-]?){13}[0-9]", "phone": r"\+[0-9]"}
SPAN = "array<struct<kind:string,start:int,stop:int,value:string>>"
BLOCK = 64

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The check that a match of ``kind`` must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def _starts(gaps: Column, lengths: Column) -> Column:
    """Where each match begins, of the gaps before the matches and the matches' lengths; sums are carried block by block."""
    n = F.size(lengths)
    both = F.zip_with(F.slice(gaps, F.lit(1), n), lengths, lambda a, b: a + b)
    total = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x)

    def from_blocks(both: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: total(F.slice(both, b * BLOCK + 1, F.lit(BLOCK))))

        def at(bases: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), n - 1), lambda j: let(
                F.floor(j / BLOCK).cast("int"),
                lambda b: F.get(bases, b) + total(F.slice(both, b * BLOCK + 1, j - b * BLOCK)) + F.get(gaps, j)))

        return let(sums, lambda s: at(F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda b: total(F.slice(s, F.lit(1), b)))))

    return let(both, from_blocks)


def places(text: Column, pattern: str) -> Column:
    """All matches, in order: start, stop (code points, end exclusive), value."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda values: F.when(F.size(values) > 0, F.zip_with(
        let(gaps, lambda g: let(F.transform(values, F.char_length), lambda n: _starts(g, n))), values,
        lambda s, v: F.struct(s.cast("int").alias("start"), (s + F.char_length(v)).cast("int").alias("stop"), v.alias("value")))).otherwise(
        F.array().cast("array<struct<start:int,stop:int,value:string>>")))


def spans_of(kind: str, text: Column) -> Column:
    """Spans of one kind, in order: kind, start, stop (code points, end exclusive), value."""
    found = F.transform(places(text, PATTERNS[kind]), lambda x: F.struct(
        F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value")))
    none = F.array().cast(SPAN)
    return F.when(text.rlike(HINTS[kind]), F.filter(found, lambda x: holds(kind, x["value"]))).otherwise(none)


def in_order(spans: Column) -> Column:
    """By start, then kind as listed, terms last."""
    rank = lambda x: F.array_position(F.array(*[F.lit(k) for k in (*KINDS, TERM)]), x["kind"])
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("a"), rank(x).alias("b"), x["stop"].alias("c"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def base_spans(text: Column) -> Column:
    """All base spans of a text, in order."""
    text = F.coalesce(text, F.lit(""))
    return in_order(F.concat(*[spans_of(k, text) for k in KINDS]))


def entity(span: Column) -> Column:
    """The protected value: lower-cased, of numbers the digits (dots kept in addresses)."""
    value = F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], value)


def _terms(line: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.transform(F.filter(F.split(line, r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != ""), F.lower))


def _lines(found: DataFrame) -> DataFrame:
    """The lines of ``found`` that hold base spans: key, hash, rows (that are equal), begin, line, spans (in the
    line), terms (outside of the spans)."""
    def cut(lines: Column) -> Column:
        lengths = F.transform(lines, F.char_length)
        ends = let(lengths, lambda n: _starts(n, F.transform(n, lambda _: F.lit(1))))
        return F.zip_with(ends, lines, lambda e, x: F.struct((e - F.char_length(x)).alias("begin"), e.alias("end"), x.alias("line")))

    # a span never goes over a line's end
    rows = found.select("key", "hash", "rows", "spans", F.explode(let(F.split("text", "\n"), lambda x: F.filter(
        cut(x), lambda c: F.exists("spans", lambda s: (s["start"] >= c["begin"]) & (s["start"] < c["end"]))))).alias("c"))
    rows = rows.select("key", "hash", "rows", "c.begin", "c.line", F.filter(
        "spans", lambda s: (s["start"] >= F.col("c.begin")) & (s["start"] < F.col("c.end"))).alias("spans"))
    rest = F.aggregate("spans", F.col("line"), lambda t, s: F.replace(t, s["value"], F.lit(" ")))
    return rows.withColumn("terms", _terms(rest))


def _contexts(lines: DataFrame) -> DataFrame:
    """The different lines that hold base spans: line_hash, copies, entities, terms."""
    return lines.groupBy(F.xxhash64("line").alias("line_hash")).agg(
        F.sum("rows").alias("copies"), F.array_distinct(F.transform(F.first("spans"), entity)).alias("entities"), F.first("terms").alias("terms"))


def _pairs(contexts: DataFrame) -> DataFrame:
    """(line_hash, copies, entity, term) of each different line."""
    return contexts.select("line_hash", "copies", "terms", F.explode("entities").alias("entity")).select(
        "line_hash", "copies", "entity", F.explode("terms").alias("term"))


def disclosing_terms(docs: DataFrame, contexts: DataFrame, text: str, generalise_at: float, remove_at: float, support: int) -> DataFrame:
    """(entity, term, action) of terms that reveal too much of an entity."""
    candidates = _pairs(contexts).groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.count(F.lit(1)).alias("different"))
    whole = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    # all lines of the corpus are counted, term by term, before anything is joined
    of_term = docs.select(F.explode(whole).alias("line")).select(F.explode(_terms(F.col("line"))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_term"))
    total = float(docs.agg(F.sum(F.size(whole))).first()[0] or 1)
    of_entity = contexts.select("copies", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    sure = F.col("n_both") * F.least(F.lit(1.0), F.col("different") / float(support))
    pmi = F.log(sure * total / (F.col("n_term") * F.col("n_entity")))
    share = pmi / F.greatest(F.log(total / F.col("n_entity")), F.lit(1e-9))
    return candidates.join(of_term, "term").join(of_entity, "entity").withColumn("share", share).where(F.col("share") >= generalise_at).select(
        "entity", "term", F.when(F.col("share") >= remove_at, "remove").otherwise("generalise").alias("action"))


def _term_spans(lines: DataFrame, contexts: DataFrame, terms: DataFrame) -> DataFrame:
    """key, hash, extra: spans of disclosing terms in the lines of their entities, not inside of base spans."""
    hits = materialize(_pairs(contexts).join(terms, ["entity", "term"]).groupBy("line_hash").agg(
        F.map_from_entries(F.collect_set(F.struct("term", F.lit(1)))).alias("found"),
        F.collect_set(F.when(F.col("action") == "remove", F.col("term"))).alias("removed")))
    by_line = lines.withColumn("line_hash", F.xxhash64("line")).join(hits, "line_hash")
    placed = F.transform(places(F.col("line"), r"[\p{L}\p{M}\p{N}]+"), lambda x: F.struct(
        F.lit(TERM).alias("kind"), (x["start"] + F.col("begin")).cast("int").alias("start"), (x["stop"] + F.col("begin")).cast("int").alias("stop"),
        x["value"].alias("value")))
    free = F.filter(placed, lambda x: F.map_contains_key("found", F.lower(x["value"])) & ~F.exists(
        "spans", lambda b: (x["start"] < b["stop"]) & (b["start"] < x["stop"])))
    marked = F.transform(free, lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"),
        F.when(F.array_contains("removed", F.lower(x["value"])), "").otherwise("[term]").alias("value")))
    return by_line.select("key", "hash", marked.alias("extra")).groupBy("key", "hash").agg(F.flatten(F.collect_list("extra")).alias("extra"))


def find(docs: DataFrame, key: str, text: str, generalise_at: float = 0.7, remove_at: float = 0.95, support: int = 3) -> tuple[DataFrame, DataFrame]:
    """Spans of all rows. First frame, a row for each row: key, hash (of the text), spans (base); second, a row for each
    (key, hash) with terms: key, hash, extra (their spans; value is what replaces them)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(whole).alias("hash"), base_spans(whole).alias("spans"), whole.alias("text"))
    found = materialize(rows.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))))
    lines = materialize(_lines(found.where(F.col("text").isNotNull()).groupBy("key", "hash").agg(
        F.count(F.lit(1)).alias("rows"), F.first("spans").alias("spans"), F.first("text").alias("text"))))
    contexts = materialize(_contexts(lines))
    terms = materialize(disclosing_terms(docs, contexts, text, generalise_at, remove_at, support))
    return found.drop("text"), materialize(_term_spans(lines, contexts, terms))


def with_terms(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """Adds all (base spans and terms, in order) to rows that have key, hash and spans."""
    match = F.col("l.key").eqNullSafe(F.col("r.key")) & (F.col("l.hash") == F.col("r.hash"))
    both = rows.alias("l").join(extra.alias("r"), match, "left")
    return both.select("l.*", in_order(F.concat("l.spans", F.coalesce("r.extra", F.array().cast(SPAN)))).alias("all"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with base spans replaced by their kind in brackets and terms by what their value says."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        label = F.when(s["kind"] == TERM, s["value"]).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        added = F.concat(done["out"], F.substr(text, done["at"] + 1, s["start"] - done["at"]), label)
        return F.when(s["start"] >= done["at"], F.struct(s["stop"].alias("at"), added.alias("out"))).otherwise(
            F.struct(F.greatest(done["at"], s["stop"]).alias("at"), done["out"].alias("out")))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(
        spans, state, step, lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1))))


def sanitise(docs: DataFrame, key: str, text: str, **options) -> DataFrame:
    """``docs`` with personal data and disclosing terms taken out of ``text``; null stays null."""
    _, extra = find(docs, key, text, **options)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(key).alias("key"),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), base_spans(F.col(text)).alias("spans"))
    done = with_terms(rows, extra)
    return done.select(*[
        F.when(F.col(f"row.{c}").isNotNull(), redacted(F.col(f"row.{c}"), F.col("all"))).alias(c) if c == text else F.col(f"row.{c}").alias(c)
        for c in docs.columns])
