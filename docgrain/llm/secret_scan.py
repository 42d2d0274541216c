"""Secret scans by a trigram index.

Each rule's regular expression is turned, on the driver, into a Boolean query: alternatives of trigrams that any match
must hold. The index has a posting for each document and each trigram of these queries. Intersecting the postings gives
the candidates of a rule, and only these are searched by the expression itself; a rule without mandatory trigrams
searches every text. All of it is DataFrame operations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import broadcast_checked, staged, table

#: Candidates (at most 40 bytes each) up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Rule:
    """`least` code points in `group` make a match count; shorter ones still use up their text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False
    base: bool = False


# The first three are the contract's.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, False, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, False, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
)


class Pattern:
    """What a regular expression says of its matches: the alternatives of its literal runs, and how long its items are.

    Literals, escapes, classes, groups, alternatives and repeats are read; anything else is refused.
    """

    def __init__(self, pattern: str):
        self.at, self.text = 0, pattern
        self.items = self.alternatives()
        if self.at < len(pattern):
            raise ValueError(f"unbalanced group in {pattern!r}")

    def alternatives(self) -> list[list[tuple]]:
        """Branches of items (kind, value, least, most); most is None where a repeat has no end."""
        branches: list[list[tuple]] = [[]]
        while self.at < len(self.text) and self.text[self.at] != ")":
            if self.text[self.at] == "|":
                self.at += 1
                branches.append([])
            else:
                branches[-1].append(self.item())
        return branches

    def item(self) -> tuple:
        c = self.text[self.at]
        self.at += 1
        if c == "(":
            if self.text.startswith("?", self.at) and not self.text.startswith("?:", self.at):
                raise ValueError(f"group not supported in {self.text!r}")
            self.at += 2 * self.text.startswith("?:", self.at)
            what = ("group", self.alternatives())
            self.at += 1
        elif c == "[":
            end = self.at + 1
            while self.text[end] != "]":
                end += 1 + (self.text[end] == "\\")
            self.at = end + 1
            what = ("any", None)
        elif c == "\\":
            hexadecimal = re.compile("x([0-9a-fA-F]{2})").match(self.text, self.at)
            escaped = self.text[self.at]
            if not hexadecimal and escaped.isalnum() and escaped not in "dDsSwW":
                raise ValueError(f"escape not supported in {self.text!r}")
            what = ("literal", chr(int(hexadecimal[1], 16))) if hexadecimal else ("any", None) if escaped.isalnum() else ("literal", escaped)
            self.at += 3 if hexadecimal else 1
        elif c in "^$*+?{":
            raise ValueError(f"{c} not supported in {self.text!r}")
        else:
            what = ("any", None) if c == "." else ("literal", c)
        return (*what, *self.repeat())

    def repeat(self) -> tuple[int, int | None]:
        found = re.compile(r"([*+?])|\{(\d+)(,(\d*))?\}").match(self.text, self.at)
        if not found:
            return 1, 1
        self.at = found.end()
        if found[1]:
            return {"*": (0, None), "+": (1, None), "?": (0, 1)}[found[1]]
        return int(found[2]), int(found[2]) if not found[3] else int(found[4]) if found[4] else None

    def runs(self, limit: int = 64) -> list[tuple[str, ...]]:
        """Alternatives of literal runs, one of which any match holds whole; '' stands where the text isn't fixed."""

        def walk(branches: list[list[tuple]]) -> list[list[str]]:
            out = []
            for items in branches:
                ways: list[list[str]] = [[""]]
                for kind, value, least, most in items:
                    once = [[value]] if kind == "literal" else walk(value) if kind == "group" else [["", ""]]
                    if (least, most) == (1, 1):
                        parts = once
                    elif (least, most) == (0, 1) and kind == "literal":
                        parts = [[""], *once]
                    else:
                        parts = [[*w, "", ""] for w in once] if least else [["", ""]]
                    if len(ways) * len(parts) > limit:
                        parts = [["", ""]]
                    ways = [[*a[:-1], a[-1] + b[0], *b[1:]] for a in ways for b in parts]
                out += ways
            return out

        return [tuple(w) for w in walk(self.items)]

    def longest(self, items: list[tuple]) -> int | None:
        """Code points that the items match at most; None for no end."""
        total = 0
        for kind, value, _, most in items:
            one = max(((0 if n is None else n, n is None) for n in map(self.longest, value)), default=(0, False)) if kind == "group" else (1, False)
            if most is None or one[1]:
                return None
            total += most * one[0]
        return total


def trigram_query(rule: Rule) -> list[frozenset[str]]:
    """Alternatives of mandatory trigrams; none if some alternative has no trigram."""
    ways = [frozenset(run[i : i + 3] for run in way for i in range(len(run) - 2)) for way in Pattern(rule.pattern).runs()]
    return ways if all(ways) else []


def prefilter(rule: Rule) -> str:
    """An expression that finds something wherever the rule has a match that is long enough.

    `least` counts all of group 0, so a trailing repeat needs what the longest text before it leaves.
    """
    branches, pattern = Pattern(rule.pattern).items, rule.pattern
    if rule.group == 0 and len(branches) == 1 and pattern.endswith("+") and branches[0][-1][::2] == ("any", 1):
        before = Pattern(rule.pattern).longest(branches[0][:-1])
        pattern = f"{pattern[:-1]}{{{1 if before is None else max(1, rule.least - before)},}}"
    return ("(?i)" if rule.fold else "") + pattern


def trigrams(rules: tuple[Rule, ...] = RULES) -> list[tuple[str, bool]]:
    """(trigram, folded) of all queries."""
    return sorted({(t.lower() if r.fold else t, r.fold) for r in rules for way in trigram_query(r) for t in way})


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, doc_id) of the rules' trigrams; `trigram` is a place in trigrams(rules)."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("plain")).withColumn("folded", F.lower("plain"))
    found = [F.when(F.contains(F.col("folded" if fold else "plain"), F.lit(t)), F.lit(i)) for i, (t, fold) in enumerate(trigrams(rules))]
    return texts.select("doc_id", F.array_compact(F.array(*found)).alias("found")).select("doc_id", F.explode("found").alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, hits): element r of `hits` says whether rule r's query holds for the document's postings."""
    place = {t: i for i, t in enumerate(trigrams(rules))}
    words = max(1, -(-len(place) // 64))
    bit = F.expr("shiftleft(1L, trigram % 64)")
    held = index.groupBy("doc_id").agg(*(F.bit_or(F.when(F.floor(F.col("trigram") / 64) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"held{w}") for w in range(words)))
    hits = []
    for rule in rules:
        holds = F.lit(False)
        for way in trigram_query(rule):
            at = [place[(t.lower() if rule.fold else t, rule.fold)] for t in way]
            for w in range(words):
                need = sum(1 << (i % 64) for i in at if i // 64 == w)
                need -= (need >> 63) << 64  # as a signed number
                part = F.col(f"held{w}").bitwiseAND(F.lit(need).cast("long")) == need
                all_of = part if w == 0 else all_of & part
            holds |= all_of
        hits.append(holds)
    found = F.array(*hits)
    return held.select("doc_id", found.alias("hits")).where(F.exists("hits", lambda h: h))


def running(values: Column, both) -> Column:
    """Running results of an associative function over an array, by doubled strides: n log n steps, nothing grows."""
    strides = F.when(F.size(values) > 1, F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int")), lambda p: F.pow(F.lit(2), p).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(strides, values, lambda acc, stride: F.transform(acc, lambda x, i: F.when(i >= stride, both(F.get(acc, i - stride), x)).otherwise(x)))


def let(value: Column, use) -> Column:
    """`use(value)` with the value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


SPANS = "array<struct<start:bigint,kind_order:int,end:bigint,kind:string>>"


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Leftmost non-overlapping matches of a rule that are long enough: array of (start, order, end, kind) in code points."""
    pattern = ("(?i)" if rule.fold else "") + rule.pattern
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(F.transform(gaps, lambda g: F.length(g)), F.transform(whole, lambda w: F.length(w)), lambda g, w: F.struct(g.alias("gap"), w.alias("size")))
    sizes = F.filter(sizes, lambda x: x["size"].isNotNull())

    def spans(lengths: Column) -> Column:
        ends = running(F.transform(lengths, lambda x: (x["gap"] + x["size"]).cast("long")), lambda a, b: a + b)
        found = F.arrays_zip(ends.alias("end"), lengths.alias("of"), F.transform(value, lambda v: F.length(v)).alias("n"))
        return F.transform(
            F.filter(found, lambda x: x["n"] >= rule.least),
            lambda x: F.struct((x["end"] - x["of"]["size"]).alias("start"), F.lit(order).alias("kind_order"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")),
        )

    return let(sizes, spans).cast(SPANS)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of `docs` has, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` (doc_id, text, ...) with `found`: the spans of all rules by start, then rule.

    A null text counts as empty and has none. Repeated rows and rows with a null id are searched like others. Overlapping
    matches of different rules are all found. An extra column named `found` is replaced; any other keeps its values.
    """
    its_id, its_hits = unused(docs, "hit_id", "hits")
    hits = broadcast_checked(staged(candidates(build_index(docs, rules), rules)), BROADCAST_ROWS).toDF(its_id, its_hits)
    joined = docs.join(hits, F.col("doc_id").eqNullSafe(F.col(its_id)), "left")
    text = F.coalesce("text", F.lit(""))
    parts = []
    for r, rule in enumerate(rules):
        wanted = F.coalesce(F.get(its_hits, F.lit(r)), F.lit(False)) if trigram_query(rule) else F.rlike(text, F.lit(prefilter(rule)))
        parts.append(F.when(wanted, spans_of(text, rule, r)).otherwise(F.expr(f"CAST(array() AS {SPANS})")))
    return joined.withColumn("found", F.array_sort(F.concat(*parts))).drop(its_id, its_hits)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Code points in a block of a text that is cut in many places, so that no cut walks from the text's start.
CUT_BLOCK = 1024


def replaced(text: Column, spans: Column) -> Column:
    """`text` with each span (overlapping ones together) replaced by the first one's kind in brackets."""

    def whole(blocks: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            first = F.floor(start / CUT_BLOCK).cast("int")
            some = F.slice(blocks, first + 1, F.floor(end / CUT_BLOCK).cast("int") - first + 1)
            return F.substring(F.array_join(some, ""), (start - first * CUT_BLOCK + 1).cast("int"), (end - start).cast("int"))

        def merged(reach: Column) -> Column:
            # reach: the furthest end up to each span; a span that starts beyond its predecessors' has a label of its own
            before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0).cast("long"))
            parts = F.transform(spans, lambda s, i: F.when((i == 0) | (s["start"] >= before(i)), F.concat(piece(before(i), s["start"]), F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit("")))
            return F.concat(F.array_join(parts, ""), piece(F.element_at(reach, -1), F.length(text).cast("long")))

        return let(running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), merged)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT_BLOCK}}}"), F.lit(0)), whole)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with each span of a secret (overlapping ones together) replaced by its kind in brackets; n_chars follows."""
    columns = docs.columns
    (kept,) = unused(docs, "own_found")
    rows = scan(docs.withColumnRenamed("found", kept), rules)  # a column named `found`, in letters of any case, keeps its values here
    changed = F.size("found") > 0
    rows = rows.withColumn("text", F.when(changed, replaced(F.col("text"), F.col("found"))).otherwise(F.col("text")))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*(F.col(kept).alias(c) if c.lower() == "found" else c for c in columns))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found")
    base = [r.kind for r in RULES if r.base]

    def of(kind: str) -> Column:
        return F.filter("found", lambda s: s["kind"] == kind)

    own = F.filter("found", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base), F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


QUERIES = {"op8_secret_scan": op8_secret_scan}
