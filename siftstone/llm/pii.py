"""Personal data, and terms that give it away: spans by pattern and by corpus co-occurrence. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.llm.shared import attach, cut

#: Patterns by kind, in the order of listing. Possessive forms match what greedy ones would; an address
#: starts where a run of its characters does, or where the match before it ended, so no run is read twice.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: What a text must have for a kind to be looked for.
_HINTS = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": lambda t: t.rlike(r"\+[0-9]")}
#: A term gives an entity away if so many distinct texts have it beside the entity and it has
#: that share of the entity's information: pmi(term, entity) / -log2 P(entity).
LEAST_TEXTS, DISCLOSURE = 3, 0.9
_SPAN = "array<struct<kind:string,at:int,to:int,value:string>>"
#: A term: a whole run of letters, marks and digits, but no word of one to three small letters (to, of).
_WORD = r"(?<![\p{L}\p{M}\p{N}])(?!\p{Ll}{1,3}(?![\p{L}\p{M}\p{N}]))[\p{L}\p{M}\p{N}]++"


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]?[0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])?$"))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _only(kind: str):
    return lambda x: _valid(kind, x["value"])


def _of(kind: str):
    return lambda x: x["kind"] == kind


def _located(text: str, pattern: str) -> tuple[Column, Column]:
    """The matches of a pattern, and the pieces of text around them (one more)."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def base_spans(rows: DataFrame) -> DataFrame:
    """Adds ``found``: valid spans of column ``text`` (code points, end exclusive), by kind, then place."""
    for kind, pattern in PATTERNS.items():
        # a piece that begins at 0 is empty in a split only if a match of no width is there; none is
        matches, around = _located("text", pattern)
        hint = _HINTS[kind](F.col("text"))
        rows = rows.withColumn(f"m_{kind}", F.when(hint, matches)).withColumn(f"g_{kind}", F.when(hint, F.transform(around, lambda x: F.length(x))))
        ends = F.expr(
            f"aggregate(m_{kind}, named_struct('at', 0, 'i', 0, 'out', cast(array() as {_SPAN})), (a, m) -> named_struct('at', a.at + get(g_{kind}, a.i) + length(m), 'i', a.i + 1, "
            f"'out', concat(a.out, array(named_struct('kind', '{kind}', 'at', a.at + get(g_{kind}, a.i), 'to', a.at + get(g_{kind}, a.i) + length(m), 'value', m)))), a -> a.out)"
        )
        rows = rows.withColumn(f"s_{kind}", F.when(F.size(f"m_{kind}") > 0, F.filter(ends, _only(kind))))
    empty = F.array().cast(_SPAN)
    return rows.withColumn("found", F.concat(*[F.coalesce(f"s_{k}", empty) for k in KINDS])).drop(*[f"{p}_{k}" for p in "mgs" for k in KINDS])


def _terms(text: str) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower))


def _rest(rows: DataFrame) -> DataFrame:
    """Adds ``rest``: the text with its base spans blank, in which terms are counted and marked."""
    blank = (
        "aggregate(array_sort(transform(found, x -> named_struct('at', x.at, 'to', x.to))), named_struct('at', 0, 'out', ''), (a, x) -> named_struct('at', greatest(a.at, x.to), "
        "'out', concat(a.out, substring(text, a.at + 1, x.at - a.at), repeat(' ', x.to - greatest(a.at, x.at)))), a -> concat(a.out, substring(text, a.at + 1)))"
    )
    return rows.withColumn("rest", F.when(F.size("found") > 0, F.expr(blank)).otherwise(F.col("text")))


def _entities(found: str) -> Column:
    """What spans name: each value, and what of it is shared with others: an address's name and its domain, an IP address's network of 256, a card's issuer."""
    value = lambda x: F.concat(x["kind"], F.lit(":"), x["value"])
    email, ip, card = (F.filter(found, _of(k)) for k in ("email", "ip", "card"))
    parts = [
        F.transform(found, value),
        F.transform(email, lambda x: F.concat(F.lit("name:"), F.lower(F.substring_index(x["value"], "@", 1)))),
        F.transform(email, lambda x: F.concat(F.lit("domain:"), F.lower(F.substring_index(x["value"], "@", -1)))),
        F.transform(ip, lambda x: F.concat(F.lit("network:"), F.substring_index(x["value"], ".", 3))),
        F.transform(card, lambda x: F.concat(F.lit("issuer:"), F.substring(F.regexp_replace(x["value"], "[^0-9]", ""), 1, 6))),
    ]
    return F.array_distinct(F.concat(*parts))


def disclosing(rows: DataFrame, docs: DataFrame, least: int = LEAST_TEXTS, share: float = DISCLOSURE) -> DataFrame:
    """(entity, term, disclosure) of terms that give entities away: whole values, and names, domains, networks and issuers.

    ``rows`` has k1, k2 and found of each document, ``docs`` k1, k2 and text. With N documents, n_e that hold the entity, n_t
    that hold the term and n_te that hold both, disclosure = log2(N * n_te / (n_t * n_e)) / log2(N / n_e): 1 if the term
    occurs with the entity alone. It must reach ``share``, from ``least`` distinct texts. As n_te is at most n_e, no term of
    more than N ** (1 - share) * n_e ** share documents can; such pairs, and entities and terms of too few texts, are
    left out before pairs are made, which changes nothing. Only terms of the entities' own texts are counted over all documents.
    """
    total = float(rows.count())
    held = cut(rows.where("size(found) > 0").select("k1", "k2", F.explode(_entities("found")).alias("entity")).groupBy("k1", "k2", "entity").agg(F.count("*").alias("n")))
    holders = cut(held.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("texts")).where((F.col("texts") >= least) & (F.col("n_e") < total)).drop("texts"))
    most = holders.agg(F.max("n_e")).first()[0]
    if most is None:
        return holders.select("entity", F.lit("").alias("term"), F.lit(0.0).alias("disclosure"))
    within = lambda n_e: F.pow(F.lit(total), F.lit(1 - share)) * F.pow(n_e, F.lit(share)) * 1.001
    who = cut(attach(held, holders, ["entity"], "inner"))
    texts = attach(docs, cut(who.select("k1", "k2").distinct()), ["k1", "k2"], "inner").groupBy("k1", "k2").agg(F.any_value("text").alias("text"))
    named = cut(_rest(base_spans(texts)).select("k1", "k2", F.explode(_terms("rest")).alias("term")))
    candidates = cut(named.groupBy("term").agg(F.count("*").alias("texts")).where(F.col("texts") >= least).select("term"))
    uses = attach(_rest(base_spans(docs)).select(F.explode(_terms("rest")).alias("term")), candidates, ["term"], "inner").groupBy("term").agg(F.count("*").alias("n_t"))
    uses = cut(uses.where(F.col("n_t") <= within(F.lit(most))))
    both = who.join(attach(named, uses, ["term"], "inner"), ["k1", "k2"]).where(F.col("n_t") <= within(F.col("n_e")))
    both = both.groupBy("entity", "term", "n_e", "n_t").agg(F.sum("n").alias("n_te"), F.count("*").alias("texts")).where(F.col("texts") >= least)
    own = F.log2(F.lit(total) / F.col("n_e"))
    pmi = F.log2(F.lit(total) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    return cut(both.select("entity", "term", (pmi / own).alias("disclosure")).where(F.col("disclosure") >= share))


def personal(docs: DataFrame, least: int = LEAST_TEXTS, share: float = DISCLOSURE) -> DataFrame:
    """(doc_id, k1, k2, found, terms) per row of ``docs``: valid base spans, and spans of terms that give an entity of the corpus away."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    rows = cut(base_spans(keyed).select("doc_id", "k1", "k2", "found"))
    pairs = disclosing(rows, keyed.drop("doc_id"), least, share)
    # a term gives its entity away in any document, above all where the entity itself isn't named
    telling = cut(pairs.select("term").distinct())
    if not telling.limit(1).count():
        return rows.withColumn("terms", F.array().cast(_SPAN))
    used = _rest(base_spans(keyed)).select("k1", "k2", F.explode(_terms("rest")).alias("term"))
    wanted = cut(attach(used, telling, ["term"], "inner").groupBy("k1", "k2").agg(F.collect_set("term").alias("wanted")))
    texts = attach(keyed.drop("doc_id"), wanted, ["k1", "k2"], "inner").groupBy("k1", "k2").agg(F.any_value("text").alias("text"), F.any_value("wanted").alias("wanted"))
    texts = _rest(base_spans(texts)).withColumn("word", F.lit(_WORD))
    spans = (
        f"aggregate(filter(zip_with(split(rest, word, -1), regexp_extract_all(rest, word, 0), (g, m) -> named_struct('g', length(g), 'm', m)), p -> p.m is not null), named_struct('at', 0, 'out', cast(array() as {_SPAN})), (a, p) -> named_struct("
        "'at', a.at + p.g + length(p.m), 'out', if(array_contains(wanted, lower(p.m)), concat(a.out, array(named_struct('kind', 'term', 'at', a.at + p.g, 'to', a.at + p.g + length(p.m), 'value', p.m))), a.out)), a -> a.out)"
    )
    terms = cut(texts.select("k1", "k2", F.expr(spans).alias("terms")))
    out = attach(rows, terms, ["k1", "k2"], "left")
    return out.select("doc_id", "k1", "k2", "found", F.coalesce("terms", F.array().cast(_SPAN)).alias("terms"))


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    kinds = F.array(*map(F.lit, (*KINDS, "term")))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["at"].alias("at"), F.array_position(kinds, x["kind"]).alias("k"), x["to"].alias("to"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(kinds, x["k"].cast("int") - 1), x["at"], x["to"])), ",")


def find_personal(docs: DataFrame, least: int = LEAST_TEXTS, share: float = DISCLOSURE) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of ``docs``.

    spans lists every span as kind:start:end (code points, end exclusive): e-mail addresses, IPv4 addresses, card and
    phone numbers by pattern, and ``term`` spans, words whose corpus co-occurrence gives an entity away, also in documents without that entity.
    An entity is a value, or a name, domain, network or issuer that values share. ``least`` and ``share`` are the distinct texts and the
    share of an entity's information that a term must have; a share just reached counts.

    A null text is empty. Rows with equal texts get equal results, repeated rows each; spans of two kinds that begin alike stand in order of
    kinds; texts of any length are read whole; an empty table gives none. Other columns are ignored.
    """
    rows = personal(docs, least, share)
    counts = [F.size(F.filter("found", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", *counts, F.sha2(_listed(F.col("found")).cast("binary"), 256).alias("base_sha256"), _listed(F.concat("found", "terms")).alias("spans"))


def sanitise(docs: DataFrame, least: int = LEAST_TEXTS, share: float = DISCLOSURE) -> DataFrame:
    """(doc_id, text): personal data generalised to its kind in angle brackets, terms that give it away removed; overlapping spans go as one.

    A null text stays null; otherwise as in ``find_personal``.
    """
    rows = personal(docs, least, share)
    spans = rows.select("k1", "k2", F.array_sort(F.transform(F.concat("found", "terms"), lambda x: F.struct(x["at"].alias("at"), x["to"].alias("to"), x["kind"].alias("kind")))).alias("spans")).where("size(spans) > 0")
    spans = cut(spans.groupBy("k1", "k2").agg(F.any_value("spans").alias("spans")))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    clean = (
        "aggregate(spans, named_struct('at', 0, 'out', ''), (a, x) -> named_struct('at', greatest(a.at, x.to), 'out', if(x.at < a.at, a.out, "
        "concat(a.out, substring(text, a.at + 1, x.at - a.at), if(x.kind = 'term', '', concat('<', upper(x.kind), '>'))))), a -> concat(a.out, substring(text, a.at + 1)))"
    )
    return attach(keyed, spans, ["k1", "k2"], "left").select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.expr(clean)).alias("text"))
