"""Personal data by candidate gradient boosting, with DataFrame functions only on the main path.

Base spans (the stated patterns and checks) always stay. Generators of high recall propose more, many of them wrong and
some overlapping: addresses in spelled-out or defanged form, digit groups of the shapes of phone numbers and cards, and
long tokens of letters and digits. Each candidate gets format and context features as SQL expressions. Boosted trees
score it; trees, leaf values and the threshold of each kind are fitted on the driver (:mod:`pii_model`) and become
nested CASE expressions. A threshold is the lowest score at which the calibration half reaches ``PRECISION``. Of
candidates over it that overlap, the best score wins, then the next best that meets no winner, and so on.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pii_model import FEATURES, KINDS, SAID, WINDOW, Ensemble, fitted

# The base patterns, written without backtracking. \G and the look-behinds keep the leftmost match; a
# possessive group is matched in a loop, so no address is too long for the stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Stretches that hold all matches of the three numeric kinds.
NUMERIC = r"[0-9+][0-9\x20().+-]*[0-9]"
# Generators beside the base patterns. A card or phone number has 7 to 19 digits by its format; nothing else is bounded.
SPELLED = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({]\x20?at\x20?[\])}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?)[A-Za-z0-9-]++)++"
DEFANGED = r"(?<![0-9.])[0-9]{1,3}(?:(?:\x20?[\[(]\.[\])]\x20?|\x20?\.\x20?)[0-9]{1,3}){3}(?![0-9.])"
GROUPED = r"(?<![0-9])(?:1[\x20.-])?[(]?[0-9]{3}[)]?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
CHAIN = r"(?<![0-9])(?<![0-9][\x20.-])[0-9](?:[\x20.-]?[0-9]){8,18}(?![\x20.-]?[0-9])"
TOKEN = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,}+=*+"
#: Matches whose places are added up at a time: within a chunk one by one, then chunk by chunk.
CHUNK = 512
_MATCH = "array<struct<s:int,e:int,t:string,b:string,a:string>>"


def _none(kind: str = _MATCH) -> Column:
    return F.array().cast(kind)


def _located(text: Column, pattern: str, offset: Column | int = 0) -> Column:
    """Matches of a pattern as array<struct<s,e,t,b,a>>: place in code points, text, what stands just before and after.

    What stands between matches gives their places. Sums run in two levels, so that the work stays near linear in the
    number of matches.
    """
    zero = F.lit(offset).cast("int") if isinstance(offset, int) else offset.cast("int")
    pairs = _let(_cut(text, pattern), lambda x: F.zip_with(F.slice(x["between"], 1, F.size(x["found"])), F.zip_with(x["found"], F.slice(x["between"], 2, F.size(x["found"])), _after), _pair))

    def step(acc: Column, m: Column) -> Column:
        s = acc["at"] + m["n"]
        e = s + F.length(m["t"])
        own = F.struct(s.alias("s"), e.alias("e"), m["t"].alias("t"), m["b"].alias("b"), m["a"].alias("a"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    def place(chunk: Column, first: Column) -> Column:
        return F.aggregate(chunk, F.struct(first.alias("at"), _none().alias("out")), step, lambda acc: acc["out"])

    def starts(acc: Column, chunk: Column) -> Column:
        size = F.aggregate(chunk, F.lit(0), lambda n, m: n + m["n"] + F.length(m["t"]))
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def placed(chunks: Column) -> Column:
        firsts = F.aggregate(chunks, F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")), starts, lambda acc: acc["out"])
        return F.flatten(F.zip_with(chunks, firsts, place))

    def chunked(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / CHUNK).cast("int")), lambda c: F.slice(x, c * CHUNK + 1, CHUNK))

    return _let(pairs, lambda x: _let(chunked(x), placed))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside a lambda an expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _cut(text: Column, pattern: str) -> Column:
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("found"), F.split(text, pattern, -1).alias("between"))


def _after(t: Column, following: Column) -> Column:
    return F.struct(t.alias("t"), F.left(following, F.lit(4)).alias("a"))


def _pair(before: Column, own: Column) -> Column:
    return F.struct(F.length(before).alias("n"), F.right(before, F.lit(WINDOW)).alias("b"), own["t"].alias("t"), own["a"].alias("a"))


def _masked(text: Column, pattern: str, keep=None) -> Column:
    """The text with matches (those that pass ``keep``) replaced by as many blanks of another kind."""
    blank = lambda t: F.repeat(F.lit("\x01"), F.length(t))
    cover = lambda b, t: F.concat(b, blank(t) if keep is None else F.when(keep(t), blank(t)).otherwise(t))
    whole = lambda x: F.concat(F.array_join(F.zip_with(F.slice(x["between"], 1, F.size(x["found"])), x["found"], cover), ""), F.element_at(x["between"], -1))
    return _let(_cut(text, pattern), whole)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Does the digit string pass Luhn's check?"""
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def worth(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).try_cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.coalesce(F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d), F.lit(0))

    return (F.length(digits) > 0) & (F.aggregate(at, F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0)


def _is_ip(t: Column) -> Column:
    return F.rlike(t, F.lit(OCTETS))


def _is_card(t: Column) -> Column:
    return _luhn(_digits(t))


def _is_phone(t: Column) -> Column:
    return F.length(_digits(t)).between(9, 15)


def _features(x: Column) -> list[Column]:
    """Format and context of a candidate with fields k, t, b and a; each a small number, named as in FEATURES."""
    t, before, after = x["t"], x["b"], x["a"]
    digits = _digits(t)
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    count = lambda drop, most=9: F.least(F.length(F.regexp_replace(t, drop, "")), F.lit(most)).cast("double")
    groups = F.filter(F.split(t, "[^0-9]+"), lambda g: g != "")
    out = {
        "kind": (x["k"] + 1).cast("double"), "digits": F.least(F.length(digits), F.lit(99)).cast("double"), "letters": count("[^A-Za-z]", 99), "length": F.least(F.length(t), F.lit(99)).cast("double"),
        "luhn": flag(F.when(F.length(digits) <= 19, _luhn(digits))), "plus": flag(F.startswith(t, F.lit("+"))), "paren": flag(F.contains(t, F.lit("("))),
        "dots": count(r"[^.]"), "dashes": count(r"[^-]"), "blanks": count(r"[^ ]"),
        "groups": F.least(F.size(groups), F.lit(9)).cast("double"), "longest": F.least(F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)), F.lit(99)).cast("double"),
        "octets": flag((F.size(groups) == 4) & F.forall(groups, lambda g: F.coalesce(g.try_cast("int") <= 255, F.lit(False)))),
        "variety": F.least(F.size(F.array_distinct(F.split(F.lower(t), ""))), F.lit(40)).cast("double"),
        "spelled": flag(F.rlike(t, F.lit(r"(?i)[\[({] ?at ?[\])}]"))),
    }
    for name, words in SAID.items():
        out[name] = flag(F.rlike(before, F.lit(f"(?i){words}[^0-9]{{0,12}}$")))
    out["assigned"] = flag(F.rlike(before, F.lit(r"[=:] ?[\"']?$")))
    out["glued"] = flag(F.rlike(before, F.lit(r"[A-Za-z0-9_/]$")) | F.rlike(after, F.lit(r"^[A-Za-z0-9_/]")))
    return [out[name].alias(name) for name in FEATURES]


def _score(model: Ensemble, f: Column) -> Column:
    """The boosted trees as nested CASE expressions."""

    def leaf(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        name, cut, low, high = node
        return F.when(f[name] <= cut, leaf(low)).otherwise(leaf(high))

    total = F.lit(model.start)
    for tree in model.trees:
        total = total + leaf(tree)
    return total


@lru_cache(maxsize=1)
def _model() -> Ensemble:
    return fitted()


def with_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (the row of ``docs`` as a struct), ``base`` and ``added``: array<struct<s int, k int, e int>> in order.

    k numbers KINDS from 0. Places are code points, ends exclusive. Null texts count as empty and have no spans.
    Repeated rows are alike; columns of any name travel inside ``row``. Base matches that fail their checks are dropped
    without a retry. An empty table gives an empty one; a text's length is not limited.
    """
    model = _model()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumns({
        "stretches": F.when(F.rlike("text", F.lit("[0-9]")), F.filter(_located(F.col("text"), NUMERIC), lambda x: x["e"] - x["s"] >= 7)).otherwise(_none()),
        "mails": F.when(F.contains("text", F.lit("@")), _located(F.col("text"), EMAIL)).otherwise(_none()),
    })
    inside = lambda pattern, keep: F.when(F.size("stretches") > 0, F.filter(F.flatten(F.transform("stretches", lambda x: _located(x["t"], pattern, x["s"]))), lambda x: keep(x["t"]))).otherwise(_none())
    rows = rows.withColumns({"ips": inside(IP, _is_ip), "cards": inside(CARD, _is_card), "phones": inside(PHONE, _is_phone)})
    tagged = lambda column, k: F.transform(column, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    rows = rows.withColumn("base", F.array_sort(F.concat(tagged("mails", 0), tagged("ips", 1), tagged("cards", 2), tagged("phones", 3))))
    # Candidates come from the text without its base spans.
    rest, busy = F.col("text"), F.size("stretches") > 0
    for name, pattern, keep in (("mails", EMAIL, None), ("ips", IP, _is_ip), ("cards", CARD, _is_card), ("phones", PHONE, _is_phone)):
        rows = rows.withColumn("rest", F.when(F.size(name) > 0, _masked(rest, pattern, keep)).otherwise(rest))
        rest = F.col("rest")
    propose = lambda pattern, k, where: F.when(where, F.transform(_located(rest, pattern), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), x["b"].alias("b"), x["a"].alias("a"), F.lit(k).alias("k")))).otherwise(_none("array<struct<s:int,e:int,t:string,b:string,a:string,k:int>>"))
    rows = rows.withColumns({
        "spelled": propose(SPELLED, 0, F.rlike(rest, F.lit(r"(?i)[\[({] ?at ?[\])}]"))),
        "defanged": propose(DEFANGED, 1, F.rlike(rest, F.lit(r"[0-9]\x20?[\[(]?\."))),
        "chains": propose(CHAIN, 2, busy),
        "grouped": propose(GROUPED, 3, busy),
        "tokens": F.filter(propose(TOKEN, 4, F.rlike(rest, F.lit("[A-Za-z0-9_+/-]{20}"))), lambda x: F.rlike(x["t"], F.lit("[0-9]")) & F.rlike(x["t"], F.lit("[A-Za-z]"))),
    })
    again = F.transform("chains", lambda x: x.withField("k", F.lit(3)))
    rows = rows.withColumn("proposed", F.concat("spelled", "defanged", "chains", again, "grouped", "tokens"))
    place = lambda x: [x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")]
    rows = rows.withColumn("proposed", F.when(F.size("proposed") > 0, F.transform("proposed", lambda x: F.struct(*place(x), F.struct(*_features(x)).alias("f")))))
    cut = F.array(*[F.lit(model.thresholds[k]) for k in KINDS])
    judged = F.transform("proposed", lambda x: F.struct((-_score(model, x["f"])).alias("p"), *place(x)))
    rows = rows.withColumn("judged", F.when(F.size("proposed") > 0, judged).otherwise(_none("array<struct<p:double,s:int,e:int,k:int>>")))
    meets = lambda x, y: (y["s"] < x["e"]) & (x["s"] < y["e"])
    good = F.filter("judged", lambda x: (-x["p"] >= F.element_at(cut, x["k"] + 1)) & ~F.exists("base", lambda b: meets(x, b)))
    chosen = F.aggregate(F.array_sort(good), _none("array<struct<p:double,s:int,e:int,k:int>>"), lambda acc, x: F.when(F.exists(acc, lambda y: meets(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select("row", "base", F.array_sort(F.transform(chosen, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, n_spans."""
    rows = with_spans(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    of_kind = lambda k: lambda x: x["k"] == k
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of ``text_col`` replaced by its kind in brackets; where base spans overlap, the first counts."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.coalesce(F.col("row").getField(text_col), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        out = F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.element_at(names, x["k"] + 1), F.lit("]"))
        return F.when(x["s"] >= acc["at"], F.struct(x["e"].alias("at"), out.alias("out"))).otherwise(acc)

    whole = F.aggregate(F.array_sort(F.concat("base", "added")), start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    changed = F.when(F.size("base") + F.size("added") > 0, whole).otherwise(F.col("row").getField(text_col))
    return with_spans(docs, text_col).select(*[changed.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


__all__ = ["FEATURES", "KINDS", "find_personal_data", "joined", "redact", "with_spans"]
