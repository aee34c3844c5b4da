"""URL filters: a list of rules decides where one fits; elsewhere association rules mined from the labels that the list gives.

1. A rule has a host and a path. It fits its host and all subdomains, if the URL's path starts with the rule's; the longest wins. The list is
   the caller's own, so it is part of the plan, as one expression.
2. URLs become sets of tokens: scheme, labels and ends of the host, path segments, file extension, query keys and pairs, fragment; digits count as `0`.
3. From labelled URLs (distinct ones; MOST_LABELLED at most, chosen by hash) the VOCABULARY frequent tokens that tell most about the label are
   taken (one of those that the very same URLs have), and of each URL the ITEMS that tell most of these, with its label, are what Spark's FP-growth mines. The sets
   that lead to a label are counted once more over all tokens of these URLs; they become rules if support and confidence then suffice, and if
   no rule with fewer of the same tokens is as sure.
4. Each URL's tokens are looked up in an inverted index of the rules, each of which stands under its rarest token. Of the rules whose tokens
   the URL has all, the surest decides (then the better supported, the shorter, the first by tokens). A URL without any is allowed.

An itemset has ITEMS + 1 items at most and occurs in MIN_SUPPORT of the URLs at least, each of which has 2 ** (ITEMS + 1) sets; so there are at most
2 ** (ITEMS + 1) / MIN_SUPPORT of them whatever the input. That bounds the model, which the driver holds and the tasks get. Everything but the
sample for learning reads all rows; judging is one scan without a shuffle, so that a host with a third of all URLs costs nothing more.

A null URL or one without `://` has an empty host and path and no tokens: no rule fits and it is allowed. Repeated rows are judged each, alike;
for learning they count once. Without labels there are no mined rules. Extra columns stay. An empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.llm.common import arrow_map, keep, unused

ALLOW, BLOCK = "allow", "block"
#: Labelled URLs to learn from, tokens that may be mined, and tokens of one URL that are.
MOST_LABELLED, VOCABULARY, ITEMS = 200_000, 2_000, 6
#: Of the labelled URLs: the least share, and the least number, that a rule stands on; the least share of them that it is right about.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.005, 5, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks label items: no token begins with it.
_LABEL = "="

#: The list of the registered query, as (verdict, host and path).
LISTED = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)


def fitting(host: Column, path: Column, listed: Sequence[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. Of rules with the same host and path the first counts."""
    found: Column | None = None
    for verdict, rule in sorted(listed, key=lambda x: -len(x[1])):
        own, slash, below = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + below))
        what = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, what) if found is None else found.when(fits, what)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a URL, in lower case, each run of digits as `0`."""
    plain = lambda x: F.regexp_replace(F.lower(x), r"[0-9]+", "0")
    marked = lambda mark, array: F.transform(F.filter(array, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    labels = F.split(plain(host), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(3))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    segments = F.split(plain(path), "/")
    query = plain(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))
    pairs = F.split(query, "&")
    parts = (
        marked("scheme:", F.array(plain(F.substring_index(url, "://", 1)))),
        marked("label:", labels),
        marked("end:", ends),
        marked("first:", F.array(F.coalesce(F.get(segments, F.lit(1)), F.lit("")))),
        marked("segment:", F.slice(segments, 3, F.size(segments))),
        marked("type:", F.array(F.regexp_extract(plain(path), r"\.([a-z0-9]{1,8})$", 1))),
        marked("key:", F.transform(pairs, lambda x: F.substring_index(x, "=", 1))),
        marked("pair:", pairs),
        marked("fragment:", F.array(plain(F.regexp_extract(url, r"#(.*)$", 1)))),
    )
    return F.when(F.instr(url, "://") > 0, F.array_distinct(F.concat(*parts))).otherwise(F.array().cast("array<string>"))


@dataclass
class Mined:
    """A rule: URLs with all these tokens have this verdict."""

    tokens: frozenset[str]
    verdict: str
    confidence: float
    support: float

    def rank(self) -> tuple:
        return -self.confidence, -self.support, len(self.tokens), sorted(self.tokens)


@dataclass
class Model:
    """Mined rules, surest first, and where each is looked up."""

    rules: list[Mined]
    often: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.rules = sorted(self.rules, key=Mined.rank)
        self.index: dict[str, list[int]] = {}
        for k, rule in enumerate(self.rules):
            rarest = min(rule.tokens, key=lambda t: (self.often.get(t, 0), t))
            self.index.setdefault(rarest, []).append(k)

    def match(self, found: Sequence[str]) -> Mined | None:
        """The surest rule that holds only tokens of these."""
        have, best = set(found), len(self.rules)
        for token in have:
            for k in self.index.get(token, ()):
                if k >= best:
                    break
                if self.rules[k].tokens <= have:
                    best = k
                    break
        return self.rules[best] if best < len(self.rules) else None

    def all_matches(self, found: Sequence[str]) -> Iterator[Mined]:
        have = set(found)
        for token in have:
            yield from (self.rules[k] for k in self.index.get(token, ()) if self.rules[k].tokens <= have)


def pruned(rules: list[Mined]) -> list[Mined]:
    """Without the rules that one with some of their tokens makes needless, being as sure at least."""
    sure = {(r.tokens, r.verdict): r.confidence for r in rules}
    out = []
    for rule in rules:
        fewer = itertools.chain.from_iterable(itertools.combinations(sorted(rule.tokens), n) for n in range(1, len(rule.tokens)))
        if all(sure.get((frozenset(x), rule.verdict), -1.0) < rule.confidence for x in fewer):
            out.append(rule)
    return out


def learn(labelled: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Rules from rows of url, tokens and verdict (allow or block)."""
    n = labelled.agg(F.approx_count_distinct("url", 0.02)).first()[0]
    share = 1.0 if n <= 0.9 * most else 0.9 * most / n
    chosen = labelled if share == 1.0 else labelled.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = keep(chosen.groupBy("url").agg(F.min(F.struct("verdict", "tokens")).alias("x")).select("url", "x.*"), "urls")
    total, blocked = sample.agg(F.count("*"), F.count(F.when(F.col("verdict") == BLOCK, 1))).first()
    if not total:
        return Model([])
    support = max(MIN_SUPPORT, MIN_COUNT / total)
    if support > 1:
        return Model([])
    counts = sample.select("url", "verdict", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count(F.when(F.col("verdict") == BLOCK, 1)).alias("b"), F.bit_xor(F.xxhash64("url")).alias("where"))
    # tokens of the very same URLs say the same: one of them is enough
    counts = counts.groupBy("n", "b", "where").agg(F.min("token").alias("token"))
    heavy = lambda *xs: sum((F.when(x > 0, x * F.ln(x)).otherwise(0.0) for x in xs), F.lit(0.0))
    n_, b = F.col("n").cast("double"), F.col("b").cast("double")
    told = heavy(b, n_ - b, blocked - b, total - blocked - n_ + b) - heavy(n_, total - n_) - heavy(F.lit(float(blocked)), F.lit(float(total - blocked))) + heavy(F.lit(float(total)))
    frequent = counts.filter(F.col("n") >= math.ceil(support * total)).withColumn("told", F.round(told, 6)).orderBy(F.desc("told"), "token").limit(VOCABULARY).collect()
    if not frequent:
        return Model([])
    place = {r["token"]: k for k, r in enumerate(frequent)}

    def items(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [[x[1] for x in sorted((place[t], t) for t in found if t in place)[:ITEMS]] + [_LABEL + verdict] for found, verdict in zip(batch.column("tokens").to_pylist(), batch.column("verdict").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], ["items"])

    baskets = arrow_map(sample.select("tokens", "verdict"), items, "items array<string>")
    # a hair less, so that rounding never asks for one URL more
    mined = FPGrowth(itemsCol="items", minSupport=support * (1 - 1e-9), minConfidence=MIN_CONFIDENCE / 2).fit(baskets).associationRules
    ends = mined.filter(F.get("consequent", F.lit(0)).isin(_LABEL + ALLOW, _LABEL + BLOCK)).select("antecedent").collect()
    often = {r["token"]: r["n"] for r in frequent}
    found = sorted({frozenset(r["antecedent"]) for r in ends}, key=sorted)
    rules = []
    for rule, (with_all, bad) in zip(found, _counted(sample, Model([Mined(x, "", 0.0, 0.0) for x in found], often), found), strict=True):
        verdict, right = (BLOCK, bad) if 2 * bad >= with_all else (ALLOW, with_all - bad)
        if with_all and right >= support * (1 - 1e-9) * total and right >= MIN_CONFIDENCE * with_all:
            rules.append(Mined(rule, verdict, right / with_all, right / total))
    return Model(pruned(rules), often)


def _counted(sample: DataFrame, model: Model, order: list[frozenset[str]]) -> list[tuple[int, int]]:
    """For each set of tokens, how many URLs have all of them, and how many of these are blocked: over all their tokens, not only the mined ones."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[frozenset[str], bool]] = Counter()
        for batch in batches:
            for have, verdict in zip(batch.column("tokens").to_pylist(), batch.column("verdict").to_pylist(), strict=True):
                counts.update((rule.tokens, verdict == BLOCK) for rule in shared.value.all_matches(have))
        rows = [(sorted(tokens), blocked, n) for (tokens, blocked), n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64())], ["tokens", "blocked", "n"])

    found = sample.select("tokens", "verdict").mapInArrow(run, "tokens array<string>, blocked boolean, n long").groupBy("tokens").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("blocked"), F.col("n")).otherwise(0)).alias("b")).collect()
    shared.destroy()
    counts = {frozenset(r["tokens"]): (r["n"], r["b"]) for r in found}
    return [counts.get(x, (0, 0)) for x in order]


def judge(urls: DataFrame, listed: Sequence[tuple[str, str]] = LISTED, model: Model | None = None) -> DataFrame:
    """All columns with host, path, rule, verdict, and mined (the tokens of the mined rule that decided, or null).

    model: by default learned from those of the urls that a listed rule fits. None of the new columns may be there.
    """
    if clash := {"host", "path", "rule", "verdict", "mined"} & {x.lower() for x in urls.columns}:
        raise ValueError(f"the table already has {sorted(clash)}")
    said, listed_as = unused(urls, "_tokens"), unused(urls, "_fits")
    url = F.col("url").cast("string")
    rows = urls.withColumns(dict(zip(("host", "path"), host_and_path(url), strict=True)))
    rows = rows.withColumns({said: tokens(url, F.col("host"), F.col("path")), listed_as: fitting(F.col("host"), F.col("path"), listed)})
    if model is None:
        model = learn(rows.filter(F.col(listed_as).isNotNull()).select(url.alias("url"), F.col(said).alias("tokens"), F.col(listed_as)["verdict"].alias("verdict")))
    shared = urls.sparkSession.sparkContext.broadcast(model)

    def decide(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        verdicts, rules, why = [], [], []
        for found, fits in zip(batch.column(said).to_pylist(), batch.column(listed_as).to_pylist(), strict=True):
            rule = None if fits else shared.value.match(found)
            rules.append(fits["rule"] if fits else None)
            verdicts.append(fits["verdict"] if fits else rule.verdict if rule else ALLOW)
            why.append(" ".join(sorted(rule.tokens)) if rule else None)
        rest = batch.drop_columns([said, listed_as])
        yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(x, pa.string()) for x in (rules, verdicts, why))], [*rest.schema.names, "rule", "verdict", "mined"])

    schema = rows.drop(said, listed_as).schema
    return arrow_map(rows, decide, schema.add("rule", "string").add("verdict", "string").add("mined", "string"))
