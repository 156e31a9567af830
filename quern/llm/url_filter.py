"""URLs judged by rules of hosts and by globs, all of them in one bit-parallel automaton.

The canonical URL is host, path and query joined: no scheme, no fragment, A-Z of the host in lower case, nothing else changed. The host is
what stands between the first :// and the next /, ? or #, port and user included; a null URL or one without :// has an empty canonical form.

A host rule fits its host and all subdomains where the path starts with the rule's. It becomes two globs, one for the host and one for its
subdomains; as ``*`` never passes a /, no path can pass for a host. Host rules come before globs, then the one with most literal characters,
then block before allow, then the text in order. Where nothing fits, the verdict is allow.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.url_globs import GlobAutomaton, parse, quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """action: allow or block; host without a dot in front; path: what paths must start with, "" for any."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host.translate(str.maketrans(UPPER, LOWER)) + self.path

    def globs(self) -> tuple[str, str]:
        ends = ("**",) if self.path else ("", "/**", "[?]**")  # without a path the host must end where the rule's does
        return tuple(front + quoted(self.name) + end for front in ("", "*.") for end in ends)

    @property
    def weight(self) -> int:
        return len(self.name)


@dataclass(frozen=True)
class GlobRule:
    action: str
    glob: str

    @property
    def name(self) -> str:
        return self.glob

    def globs(self) -> tuple[str, ...]:
        return (self.glob,)

    @property
    def weight(self) -> int:
        return len(parse(self.glob)[0])


HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)

#: Places that hold no prose: accounts, shops, searches, calendars, machine interfaces, files that are not text, and hosts of adverts.
_BLOCKED_PATHS = ("login", "signin", "sign-in", "logout", "register", "account", "cart", "checkout", "wp-admin", "wp-json", "cgi-bin", "calendar", "print", "share")
_BLOCKED_FILES = ("exe", "zip", "gz", "iso", "dmg", "apk", "jpg", "jpeg", "png", "gif", "mp3", "mp4", "avi", "woff2", "css", "js")
_BLOCKED_HOSTS = ("ad", "ads", "adserver", "track", "tracker", "pixel", "click", "static", "cdn", "stats")
_BLOCKED_KEYS = ("sessionid", "phpsessid", "jsessionid", "sid", "replytocom", "add-to-cart", "action=edit", "print=1")

GLOB_RULES = (
    *(GlobRule("block", f"*/**{name}{end}") for name in (f"/{p}" for p in _BLOCKED_PATHS) for end in ("", "/**", "[?]**")),
    *(GlobRule("block", f"*/{p}{end}") for p in _BLOCKED_PATHS for end in ("", "/**", "[?]**")),
    *(GlobRule("block", f"*/**.{kind}{end}") for kind in _BLOCKED_FILES for end in ("", "[?]**")),
    *(GlobRule("block", f"{host}.*{end}") for host in _BLOCKED_HOSTS for end in ("", "/**", "[?]**")),
    *(GlobRule("block", f"*{path}[?]{more}{key}**") for path in ("", "/**") for more in ("", "**&") for key in _BLOCKED_KEYS),
    GlobRule("block", "*/**/search[?]**"),
    GlobRule("block", "*/search[?]**"),
    GlobRule("block", "*/**/[12][0-9][0-9][0-9]/[01][0-9]/[0-3][0-9]/"),
    GlobRule("block", "*/[12][0-9][0-9][0-9]/[01][0-9]/[0-3][0-9]/"),
    GlobRule("allow", "*/**/login/help/**"),
    GlobRule("allow", "docs.*/**/print/**"),
)


class Judge:
    """Which rule decides a canonical URL."""

    def __init__(self, rules: Sequence[HostRule | GlobRule]):
        for rule in rules:
            if rule.action not in ("allow", "block"):
                raise ValueError(f"no such action: {rule.action}")
        ranked = sorted(set(rules), key=lambda r: (not isinstance(r, HostRule), -r.weight, r.action != "block", r.name))
        self.globs = [(glob, rule) for rule in ranked for glob in rule.globs()]
        self.automaton = GlobAutomaton([glob for glob, _ in self.globs])

    def decide(self, urls: Sequence[str]) -> Iterator[HostRule | GlobRule | None]:
        """The first rule by rank that fits each URL. Equal URLs of a batch are run once."""
        number: dict[str, int] = {}
        places = [number.setdefault(url, len(number)) for url in urls]
        hits = self.automaton.matches(list(number))
        first, some = hits.argmax(axis=1) if self.globs else None, hits.any(axis=1)
        found = [self.globs[i][1] if any_ else None for i, any_ in zip(first.tolist(), some.tolist())] if self.globs else [None] * len(number)
        return (found[place] for place in places)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query with its ?), all "" for null and for URLs without ://."""
    text = F.coalesce(url, F.lit(""))
    begin = F.locate("://", text)
    rest = F.when(begin > 0, F.substring(text, begin + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    behind = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(behind, "^[^?#]*", 0)
    query = F.regexp_extract(F.substring(behind, F.length(path) + 1, F.length(behind)), r"^\?[^#]*", 0)
    return F.translate(host, UPPER, LOWER), path, query


def judge_urls(pages: DataFrame, rules: Sequence[HostRule | GlobRule] = HOST_RULES + GLOB_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) of every row of pages; repeated rows and ids stay as they are.

    ``rule`` is the name of the host rule that decides, ``pattern`` the glob that does; at most one is not null. Other columns of pages, whatever
    their names, are not read. No shuffle: rows are judged where they are read. A text of n characters takes n steps, so a worker's
    time follows the longest URL of a batch, and its memory is bounded by MAX_CELLS words of state and the batch's URLs.
    """
    judges: list[Judge] = []  # made in the worker, once per task

    @F.pandas_udf("struct<rule: string, pattern: string, verdict: string>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = judges[0] if judges else Judge(rules)
        judges[:] = [judge]
        for batch in batches:
            found = list(judge.decide(batch.tolist()))
            yield pd.DataFrame({
                "rule": [r.name if isinstance(r, HostRule) else None for r in found],
                "pattern": [r.name if isinstance(r, GlobRule) else None for r in found],
                "verdict": [r.action if r else "allow" for r in found],
            })

    host, path, query = url_parts(F.col(url_col).cast("string"))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), query.alias("query"))
    decided = parts.withColumn("d", judged(F.concat("host", "path", "query")))
    return decided.select("page_id", "host", "path", "d.rule", "d.verdict", "d.pattern")


def allowed_pages(pages: DataFrame, rules: Sequence[HostRule | GlobRule] = HOST_RULES + GLOB_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The rows of pages that the rules allow, with all their columns. Rows with null ids or repeated ids are judged one by one."""
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(url_col).alias("url"))
    kept = judge_urls(packed, rules, "row", "url").where("verdict = 'allow'")
    return kept.select("page_id.*")
