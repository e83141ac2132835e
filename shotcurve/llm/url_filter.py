"""URL filters: pattern rules indexed by their rarest literal token.

A rule can only match a url that holds all of the rule's whole words ("literal
tokens"). How many urls hold each of them is counted over the whole table, and
the rule is filed under the rarest. The tokens of a url then fetch its candidate
rules, and only these run their regular expressions. Rules without a token are
candidates of every url.

Site rules (host and path prefix) come first: a rule fits its host and all
subdomains if the path starts with the rule's; the longest wins, a block on
ties. Where none fits, wildcard patterns decide: blocked if a blocking pattern
matches and no allowing one does. `*` is any text, `^` a character that is not
part of a word.

Defined results: null urls and those without "://" have empty host and path,
which only a pattern of wildcards can match; a url counts as it stands, repeated
rows alike; other columns stay. Rules are a configured list held by the driver.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+")


@dataclass(frozen=True)
class SiteRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def regex(self) -> str:
        return rf"(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    def tokens(self) -> set[str]:
        # the path goes on behind the rule, so its last word may be part of a longer one
        return _whole_words(self.host.replace(".", " ") + self.path, open_end=True)


@dataclass(frozen=True)
class PatternRule:
    verdict: str
    pattern: str

    @property
    def name(self) -> str:
        return self.pattern

    def regex(self) -> str:
        parts = {"*": r"[\s\S]*", "^": r"(?:\W|\Z)"}
        return r"[\s\S]*?" + "".join(parts.get(c, re.escape(c)) for c in self.pattern)

    def tokens(self) -> set[str]:
        # words next to a wildcard or at an end may be part of longer ones
        return set().union(*(_whole_words(p, open_start=True, open_end=True) for p in self.pattern.split("*")))


def _whole_words(text: str, open_start: bool = False, open_end: bool = False) -> set[str]:
    return {m[0].lower() for m in TOKEN.finditer(text)
            if not (open_start and m.start() == 0) and not (open_end and m.end() == len(text))}


# The rules of the contract
SITE_RULES = (SiteRule("allow", "org", "/"), SiteRule("block", "example.org", "/es/"),
              SiteRule("block", "example.org", "/en/1"), SiteRule("allow", "com", "/fr/"),
              SiteRule("block", "com", "/de/"))
# Paths that hold no prose
PATTERN_RULES = (PatternRule("block", "/ads/"), PatternRule("block", "/login^"),
                 PatternRule("block", "/cart/*/checkout"), PatternRule("block", "/search^"),
                 PatternRule("allow", "/search/help/"))


def token_counts(urls: DataFrame, tokens: set[str], url: str = "url") -> dict[str, int]:
    """In how many urls each of the tokens occurs: at most one row per token
    reaches the driver."""
    def of(texts):
        return pa.array([sorted(tokens & _whole_words("".join(split_url(u)))) for u in texts.to_pylist()],
                        pa.list_(pa.string()))
    seen = urls.select(F.explode(F.arrow_udf(of, "array<string>")(url)).alias("token"))
    return {r["token"]: r["n"] for r in seen.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def split_url(url: str | None) -> tuple[str, str]:
    """Host, with A-Z in lower case, and path."""
    _, mark, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def build_index(rules, counts: dict[str, int]) -> dict[str | None, list]:
    """Rules by their rarest token, None for those without one."""
    index = {}
    for number, rule in enumerate(rules):
        rarest = min(rule.tokens(), key=lambda t: (counts.get(t, 0), -len(t), t), default=None)
        index.setdefault(rarest, []).append((number, rule.regex()))
    return index


def judge(pages: DataFrame, site_rules=SITE_RULES, pattern_rules=PATTERN_RULES, url: str = "url",
          names: tuple = ("host", "path", "rule", "verdict")) -> DataFrame:
    """pages with host, path, rule (of the site rule that decided, else null)
    and verdict, under the given names, in place of columns that have these
    names in upper or lower case. Rows are judged in place."""
    rules = [*site_rules, *pattern_rules]
    counts = token_counts(pages, {t for r in rules for t in r.tokens()}, url)
    index = build_index(rules, counts)
    n_sites = len(site_rules)
    described = [(r.name, r.verdict, len(r.name)) for r in rules]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ready = {t: [(n, re.compile(x)) for n, x in found] for t, found in index.items()}
        for urls in batches:
            out = []
            for value in urls.to_pylist():
                host, path = split_url(value)
                text = host + path
                hits = [n for token in {None, *_whole_words(text)} for n, regex in ready.get(token, ())
                        if regex.match(text)]
                sites = [n for n in hits if n < n_sites]
                if sites:
                    best = max(sites, key=lambda n: (described[n][2], described[n][1] == "block", -n))
                    out.append((host, path, described[best][0], described[best][1]))
                else:
                    said = {described[n][1] for n in hits}
                    out.append((host, path, None, "block" if "block" in said and "allow" not in said else "allow"))
            yield pa.StructArray.from_arrays(
                [pa.array([o[i] for o in out], pa.string()) for i in range(4)], names=["a", "b", "c", "d"])
    found = F.arrow_udf(run, "a string, b string, c string, d string")(url)
    kept = [F.col(f"`{c}`") for c in pages.columns]
    rows = pages.select(F.struct(*kept).alias("row"), found.alias("found"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in pages.columns
                         if c.lower() not in {n.lower() for n in names}],
                       *[F.col(f"found.{c}").alias(n) for c, n in zip("abcd", names)])
