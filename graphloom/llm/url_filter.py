"""URL filters: host and path rules, and a character language-model ratio for URLs no rule fits (DataFrame operations only).

Two smoothed variable-order Markov models, one of accepted and one of rejected URLs, are fitted on all different URLs that
the rules label, together with the fixed words below. Both store, for every context up to ``ORDER - 1`` characters and next
character, a probability interpolated with the next shorter context (Witten-Bell). A character is scored under the longest
context of which a model has seen the continuation. A URL's score is the mean over its characters of log P(rejected) -
log P(accepted); it is blocked above a threshold, calibrated so that at most ``FALSE_BLOCKS`` of the accepted URLs that were
held out would be blocked.

Grams are counted on the map side before they are shuffled. The gram table grows with the URLs, up to the number of grams
that the characters allow; it is broadcast only after a count, and joined by shuffle otherwise. Scores are computed once per
distinct URL.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule, and is allowed; a URL with a path alone
is judged by it; rows may repeat, and a URL that labels many rows is learnt once; a class without labelled URLs leaves the
fixed words alone; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, ascii_lower, materialize


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)
#: Words of hosts that are commonly accepted and rejected.
ACCEPTED_WORDS = "blog news wiki docs library school university museum science history garden recipes travel weather journal archive"
REJECTED_WORDS = "casino win bets free pills cheap ads track poker slots lottery viagra porn xxx adult sex loan payday bonus jackpot click banner tracker"
#: The longest gram, one of how many labelled URLs is held out, the share of accepted ones that may be blocked, the smoothing
#: floor, and the steps of a score in which the threshold is sought.
ORDER, HELD_OUT, FALSE_BLOCKS, ALPHABET, STEPS = 4, 5, 0.01, 128, 1000


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3, F.length(url))
    known = url.isNotNull() & (at > 0)
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(F.lit("")), F.when(known, path).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule that fits, as a struct of text and verdict; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def _characters(text: Column) -> Column:
    return F.concat(F.lit("^" * (ORDER - 1)), ascii_lower(text), F.lit("$"))


def _grams(rows: DataFrame, keys: list[str], order: int) -> DataFrame:
    """The grams of ``order`` characters that end at each scored character of ``__s``."""
    last = F.length("__s") - ORDER + 1
    return rows.withColumn("__i", F.explode(F.sequence(F.lit(1), last))).select(*keys, "__i", F.substr("__s", F.col("__i") + (ORDER - order), F.lit(order)).alias("__g"))


def labelled_urls(urls: DataFrame) -> DataFrame:
    """(__s, __bad, __held): the fixed words, and every different labelled URL; a share of the URLs is held out."""
    spark = urls.sparkSession
    known = urls.where("rule is not null").select(_characters(F.concat("host", "path")).alias("__s"), (F.col("verdict") == "block").alias("__bad")).distinct()
    known = known.withColumn("__held", F.pmod(F.xxhash64("__s"), F.lit(HELD_OUT)) == 0)
    words = [(w, bad) for text, bad in ((ACCEPTED_WORDS, False), (REJECTED_WORDS, True)) for w in text.split()]
    fixed = spark.createDataFrame(words, "w string, bad boolean").select(F.explode(F.array_repeat(_characters(F.concat("w", F.lit(".example"))), 50)).alias("__s"), F.col("bad").alias("__bad"), F.lit(False).alias("__held"))
    return materialize(known.unionByName(fixed), "url-labelled")


def fit_models(sample: DataFrame) -> DataFrame:
    """(__g, __llr): for every gram seen, log P(rejected) - log P(accepted) of its last character after the others."""
    prior = None
    tables = []
    for order in range(1, ORDER + 1):
        counts = _grams(sample, ["__bad"], order).groupBy("__bad", "__g").agg(F.count("*").alias("__n"))
        context = Window.partitionBy("__bad", "__c")
        counts = counts.withColumn("__c", F.substring("__g", 1, order - 1)).withColumns({"__all": F.sum("__n").over(context), "__kinds": F.count("*").over(context)})
        both = counts.select("__g", "__c").distinct()
        for name, bad in (("good", False), ("bad", True)):
            own = counts.where(F.col("__bad") == bad)
            both = both.join(own.select("__g", F.col("__n").alias(f"__n_{name}")), "__g", "left")
            both = both.join(own.groupBy("__c").agg(F.first("__all").alias(f"__all_{name}"), F.first("__kinds").alias(f"__kinds_{name}")), "__c", "left")
        both = both.fillna(0, [f"__{k}_{n}" for k in ("n", "all", "kinds") for n in ("good", "bad")])
        if prior is None:
            both = both.withColumns({f"__low_{n}": F.lit(1.0 / ALPHABET) for n in ("good", "bad")})
        else:
            short = prior.select(F.col("__g").alias("__short"), F.col("__p_good").alias("__low_good"), F.col("__p_bad").alias("__low_bad"))
            both = both.withColumn("__short", F.substring("__g", 2, order - 1)).join(short, "__short")
        # Witten-Bell: a context seen n times with t kinds gives t / (n + t) to the shorter context.
        p = {f"__p_{n}": F.when(F.col(f"__all_{n}") == 0, F.col(f"__low_{n}")).otherwise((F.col(f"__n_{n}") + F.col(f"__kinds_{n}") * F.col(f"__low_{n}")) / (F.col(f"__all_{n}") + F.col(f"__kinds_{n}"))) for n in ("good", "bad")}
        prior = materialize(both.withColumns(p).select("__g", "__p_good", "__p_bad"), "url-model")
        tables.append(prior)
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return materialize(whole.select("__g", F.log(F.col("__p_bad") / F.col("__p_good")).alias("__llr")), "url-ratio")


def score_strings(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rows`` (__key, __s) to (__key, score): the mean log-likelihood difference a character."""
    small = model.count() <= BROADCAST_ROWS
    grams = rows.withColumn("__i", F.explode(F.sequence(F.lit(1), F.length("__s") - ORDER + 1)))
    found = F.lit(None).cast("double")
    for order in range(1, ORDER + 1):
        own = model.where(F.length("__g") == order).select(F.col("__g").alias(f"__g{order}"), F.col("__llr").alias(f"__l{order}"))
        grams = grams.withColumn(f"__g{order}", F.substr("__s", F.col("__i") + (ORDER - order), F.lit(order)))
        grams = grams.join(F.broadcast(own) if small else own, f"__g{order}", "left")
        found = F.coalesce(F.col(f"__l{order}"), found)
    return grams.groupBy("__key").agg(F.avg(F.coalesce(found, F.lit(0.0))).alias("score"))


def fit_url_filter(urls: DataFrame) -> tuple[DataFrame, float]:
    """The gram table and the calibrated threshold, from rows with host, path, rule and verdict."""
    chosen = labelled_urls(urls)
    model = fit_models(chosen.where("not __held"))
    scores = score_strings(chosen.where("__held and not __bad").select(F.col("__s").alias("__key"), "__s"), model)
    # Scores are differences of logarithms that smoothing bounds, so there are few steps, however many URLs.
    steps = scores.groupBy(F.ceil(F.col("score") * STEPS).alias("step")).agg(F.count("*").alias("n")).collect()
    spare = int(FALSE_BLOCKS * sum(n for _, n in steps))
    cut = 0.0
    for step, n in sorted(steps, reverse=True):
        cut = step / STEPS
        spare -= n
        if spare < 0:
            break
    return model, max(0.0, cut)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """One row per input row: ``id_col``, host, path, rule, verdict, score (null where a rule decides)."""
    host, path = url_parts(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path")).withColumn("__r", rule_of(F.col("host"), F.col("path"), rules))
    urls = materialize(urls.select("__id", "host", "path", F.col("__r.rule").alias("rule"), F.col("__r.verdict").alias("verdict")), "urls")
    model, cut = fit_url_filter(urls)
    key = F.concat_ws("\x00", "host", "path")
    is_open = F.col("rule").isNull() & (F.concat("host", "path") != "")
    open_urls = urls.where(is_open).select(key.alias("__key"), _characters(F.concat("host", "path")).alias("__s")).distinct()
    scores = materialize(score_strings(open_urls, model), "url-scores")
    decided = urls.where(~is_open).withColumn("score", F.lit(None).cast("double"))
    judged = urls.where(is_open).withColumn("__key", key).join(scores, "__key").drop("__key").unionByName(decided)
    blocked = F.coalesce(F.col("score") > cut, F.lit(False))
    verdict = F.coalesce("verdict", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(F.col("__id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
