"""Secret scans over a trigram inverted index.

Each rule is a regular expression. Analysing it gives a Boolean query over trigrams that every text
with a match satisfies: an OR of ANDs, such as (tok & oke & ken) | (sec & ecr & cre & ret). The index has, by
segment of texts, a sorted posting list for each trigram that some rule asks about; a rule's
candidates are intersections and unions of these lists, and only candidates are searched with the rule's
expression. A rule without mandatory trigrams (a run of hexadecimal digits) searches every text.

Texts are known by a 64-bit hash, so copies are indexed once, and a collision costs one needless
search and no match. All of this is Spark's own functions; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, stored


@dataclass(frozen=True)
class Rule:
    """kind; pattern, in the syntax that Java and Python share; the match is dropped if its `group` (0: the
    whole) has fewer than `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isascii() and c.isalpha() else c for c in words)


# The base rules. A run of hexadecimal digits is matched whole, so asking for 24 in the
# pattern equals dropping shorter runs; the same holds for the run after AKIA.
BASE = (
    Rule("assign", f"({either_case('password|passwd|secret|token|api_?key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
#: Formats of credentials that their issuers publish.
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("code_host", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_json", "eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]+"),
    Rule("maps", "AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + MORE

#: Strings or ANDs that the analysis carries along, and letters of a class that it spells out; beyond them it
#: asks for less.
MOST, MOST_LETTERS = 64, 8
#: Texts of a segment of the index, on average.
SEGMENT = 4096
#: Candidates that are broadcast (16 bytes each); more are joined.
BROADCAST_KEYS = 250_000


# --- From a regular expression to a Boolean trigram query ------------------------------------

Query = frozenset  # an OR of ANDs: a set of sets of trigrams
ANY = Query([frozenset()])


def either(*queries: Query) -> Query:
    """OR; an AND that asks for more than another one is absorbed by it."""
    all_ = set().union(*queries)
    kept = Query(a for a in all_ if not any(b < a for b in all_))
    return kept if len(kept) <= MOST else ANY


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST:
        return min(a, b, key=lambda q: (q == ANY, len(q)))  # asks for less
    return either({x | y for x, y in product(a, b)})


def asked(strings) -> Query:
    """Some of the strings is in the text."""
    return either({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


@dataclass(frozen=True)
class Facts:
    """What is known of a part's matches: all of them if they are few (exact), else how they begin and
    end (two characters), and a query that texts with one satisfy."""

    exact: frozenset | None
    first: frozenset
    last: frozenset
    query: Query = ANY

    def whole(self) -> Query:
        return self.query if self.exact is None else asked(self.exact)


def exactly(strings) -> Facts:
    strings = frozenset(strings)
    return Facts(strings, frozenset(s[:2] for s in strings), frozenset(s[-2:] for s in strings))


UNKNOWN = Facts(None, frozenset([""]), frozenset([""]))


def then(a: Facts, b: Facts) -> Facts:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST:
        return exactly(x + y for x, y in product(a.exact, b.exact))
    seam = asked(x + y for x, y in product(a.last, b.first)) if len(a.last) * len(b.first) <= MOST else ANY
    join = lambda x, y, cut: frozenset(cut(p + q) for p, q in product(x, y))
    first = join(a.exact, b.first, lambda s: s[:2]) if a.exact is not None and len(a.exact) * len(b.first) <= MOST else a.first
    last = join(a.last, b.exact, lambda s: s[-2:]) if b.exact is not None and len(b.exact) * len(a.last) <= MOST else b.last
    return Facts(None, first, last, both(both(a.whole(), b.whole()), seam))


def one_of(parts: list[Facts]) -> Facts:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST:
        return exactly(s for p in parts for s in p.exact)
    return Facts(None, frozenset().union(*(p.first for p in parts)), frozenset().union(*(p.last for p in parts)), either(*(p.whole() for p in parts)))


def _letter(code: int) -> Facts:
    return exactly([chr(code).lower()]) if code < 128 else UNKNOWN


def _class(items) -> Facts:
    found: set[str] = set()
    for op, value in items:
        if op is parser.LITERAL and value < 128:
            found.add(chr(value).lower())
        elif op is parser.RANGE and value[1] < 128:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return UNKNOWN  # negated, named or beyond ASCII
    return exactly(found) if len(found) <= MOST_LETTERS else UNKNOWN


def facts(tree) -> Facts:
    out = exactly([""])
    for op, value in tree:
        if op is parser.LITERAL:
            part = _letter(value)
        elif op is parser.IN:
            part = _class(value)
        elif op is parser.SUBPATTERN:
            part = facts(value[3])
        elif op is parser.BRANCH:
            part = one_of([facts(p) for p in value[1]])
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT):
            low, high, inner = value
            each = facts(inner)
            part = exactly([""])
            for _ in range(min(low, 3)):
                part = then(part, each)
            if (low, high) == (0, 1):
                part = one_of([each, part])
            elif low != high or low > 3:
                rest = Facts(None, frozenset([""]), frozenset([""]))
                part = then(part, rest)
                if low:  # it ends as its last round does
                    part = Facts(None, part.first, each.last if "" not in each.last else rest.last, part.query)
        elif op in (parser.AT, parser.ASSERT, parser.ASSERT_NOT):
            part = exactly([""])
        else:
            part = UNKNOWN
        out = then(out, part)
    return out


def trigram_query(pattern: str) -> Query:
    """The query over trigrams of the lower-cased text; ANY if the pattern has no mandatory ones."""
    return facts(parser.parse(pattern)).whole()


# --- The index -------------------------------------------------------------------------------


def build_index(texts: DataFrame, grams: list[str], rows: int) -> DataFrame:
    """texts: h (hash of the text), text. segment and postings: a map from each of the grams that occur in
    the segment's lower-cased texts to their hashes, sorted. rows: of texts, about."""
    low = texts.select("h", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(k)) for k, g in enumerate(grams))))
    segments = max(1, -(-rows // SEGMENT))
    lists = low.select("h", F.explode(held).alias("gram")).groupBy(F.pmod("h", F.lit(segments)).alias("segment"), "gram").agg(F.sort_array(F.collect_set("h")).alias("list"))
    return lists.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("gram", "list"))).alias("postings"))


def _answer(query: Query, grams: list[str]) -> Column:
    none = F.array().cast("array<bigint>")
    list_of = lambda g: F.coalesce(F.try_element_at("postings", F.lit(grams.index(g))), none)
    ands = []
    for conjunction in sorted(map(sorted, query)):
        hit = list_of(conjunction[0])
        for g in conjunction[1:]:
            hit = F.array_intersect(hit, list_of(g))
        ands.append(hit)
    out = ands[0]
    for hit in ands[1:]:
        out = F.array_union(out, hit)
    return out


def candidates(index: DataFrame, queries: dict[int, Query], grams: list[str]) -> DataFrame:
    """h, rules: the bits of the rules whose query the text satisfies."""
    hits = F.array(*(F.struct(F.lit(1 << k).cast("long").alias("rule"), _answer(q, grams).alias("hits")) for k, q in queries.items()))
    each = index.select(F.explode(hits).alias("x")).select(F.explode("x.hits").alias("h"), F.col("x.rule").alias("rule"))
    return each.groupBy("h").agg(F.bit_or("rule").alias("rules"))


# --- Verification ----------------------------------------------------------------------------

#: Matches that are added up at once: lists of spans grow by copying.
STEP = 512


def _located(df: DataFrame, rule: Rule, wanted: Column, name: str) -> DataFrame:
    """Adds `name`: an array of (at, kind, to) of the rule's matches, in code points.

    Splitting gives the texts between the matches, whose lengths and the matches' own add up to
    the positions."""
    pattern = F.lit(rule.pattern)
    find = wanted & F.rlike("text", pattern)
    none = F.array().cast("array<struct<gap:int,width:int,ok:boolean>>")
    gaps, whole = F.split("text", rule.pattern, -1), F.regexp_extract_all("text", pattern, F.lit(0))
    part = F.regexp_extract_all("text", pattern, F.lit(rule.group))
    matches = F.arrays_zip(whole.alias("m"), part.alias("p"), F.slice(gaps, 1, F.size(gaps) - 1).alias("g"))
    matches = F.transform(matches, lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("width"), (F.length(x["p"]) >= rule.least).alias("ok")))
    df = df.withColumn("_found", F.coalesce(F.when(find, matches), none))

    start = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["at"], F.lit(0))
    kind = F.lit(rule.kind)
    empty = F.array().cast("array<struct<start:int,kind:string,to:int,ok:boolean>>")

    def step(state, x):
        at = state["at"] + x["gap"]
        span = F.struct(at.alias("start"), kind.alias("kind"), (at + x["width"]).alias("to"), x["ok"].alias("ok"))
        return F.struct((at + x["width"]).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def block(acc, b):
        inner = F.aggregate(F.slice("_found", b * STEP + 1, F.lit(STEP)), F.struct(start(acc).alias("at"), empty.alias("spans")), step)
        return F.concat(acc, F.array(inner))

    first = F.array().cast("array<struct<at:int,spans:array<struct<start:int,kind:string,to:int,ok:boolean>>>>")
    blocks = F.aggregate(F.sequence(F.lit(0), F.floor((F.size("_found") - 1) / STEP).cast("int")), first, block)
    spans = F.when(F.size("_found") > 0, F.flatten(F.transform(blocks, lambda b: b["spans"]))).otherwise(empty)
    return df.withColumn(name, F.transform(F.filter(spans, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["to"].alias("to")))).drop("_found")


def find_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row for each row of df: id_col and, for each rule, an array s_<kind> of (start, kind, to) of its
    leftmost non-overlapping matches, in code points, `to` exclusive.

    A null text has no matches, like an empty one. Repeated rows are rows of their own, ids may be null. Other
    columns of df aren't read, so their names can't clash. An empty table gives an empty one. Texts of any
    length are searched whole.
    """
    queries = {k: trigram_query(r.pattern) for k, r in enumerate(rules)}
    narrow = {k: q for k, q in queries.items() if q != ANY}
    grams = sorted({g for q in narrow.values() for a in q for g in a})
    own = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    own = own.withColumn("h", F.xxhash64("text"))
    if narrow:
        rows = df.count()
        found = stored(candidates(build_index(own, grams, rows), narrow, grams), "candidates")
        n = found.count()
        if n <= broadcast_keys:
            own = own.join(F.broadcast(found), "h", "left")
        else:  # copies of one text are one key
            own = hot_join(own.withColumn("_row", F.monotonically_increasing_id()), found, "h", own.groupBy("h").agg(F.count("*").alias("n")), rows, "_row", "left")
    else:
        own = own.withColumn("rules", F.lit(0).cast("long"))
    out = own.select("id", "text", F.coalesce("rules", F.lit(0)).alias("rules"))
    for k, rule in enumerate(rules):
        wanted = F.col("rules").bitwiseAND(F.lit(1 << k)) != 0 if k in narrow else F.lit(True)
        out = _located(out, rule, wanted, f"s_{rule.kind}")
    return out.select(F.col("id").alias(id_col), *(f"s_{r.kind}" for r in rules))


def written(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end by start, then by the order of kinds, comma-joined."""
    order = F.create_map(*(F.lit(x) for k, name in enumerate(kinds) for x in (name, k)))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(order, s["kind"]).alias("no"), s["to"].alias("to"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["to"].cast("string"))), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, the counts of the base rules, the digest of their spans, and all spans."""
    kinds = [r.kind for r in RULES]
    of = lambda rules: F.concat(*(F.col(f"s_{r.kind}") for r in rules))
    return found.select(
        id_col,
        *(F.size(f"s_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in BASE),
        F.sha2(written(of(BASE), kinds).cast("binary"), 256).alias("base_sha256"),
        written(of(RULES), kinds).alias("spans"),
    )


def oracle() -> str:
    def spans(no: int, r: Rule) -> str:
        p = r.pattern.replace("'", "''")
        at = "(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT"
        return (
            f"SELECT k, {no} AS no, '{r.kind}' AS kind, {at} AS a, {at} + length(m[i]) AS b FROM (SELECT k, m, g, unnest(range(1, len(m) + 1)) AS i, p FROM "
            f"(SELECT k, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {r.group}) AS p, string_split_regex(t, '{p}') AS g FROM d)) WHERE length(p[i]) >= {r.least}"
        )

    every = " UNION ALL ".join(spans(no, r) for no, r in enumerate(RULES))
    text = lambda where: f"coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, no){where}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents), s AS ({every})
SELECT doc_id, {counts}, sha256({text(f" FILTER (no < {len(BASE)})")}) AS base_sha256, {text(" FILTER (no IS NOT NULL)")} AS spans
FROM d LEFT JOIN s USING (k) GROUP BY d.k, doc_id
"""
