"""URL filter: allow and block rules in a trie over reversed host labels and path segments; the longest rule wins.

A rule (verdict, host, path) fits a URL whose host is the rule's host or below it, and whose path starts
with the rule's path (as text: ``/en`` fits ``/english``, ``/en/`` does not). Of the rules that fit,
the one with the longest host wins, then the one with the longest path; if both lists have that
entry, block wins. URLs that no rule fits get ``default``.

The trie goes down by host labels from the right, then by whole path segments from the left; what a path has
after its last ``/`` is an ending of the node, compared as a prefix of the next segment. One walk
per URL costs its labels and segments, whatever the number of rules. The trie is broadcast, at most
``RULES_PER_TRIE`` rules of at most ``RULE_CHARS`` characters at once; more rules make more tries, which the
URLs pass one after another, and the longest rule of all tries wins, so the result is the same.

Defined cases: a null URL or one without ``://`` has an empty host and path, which no rule fits; null or
empty rule hosts are errors, a null rule path is empty. Repeated rules count once; repeated rows, ties and
extra columns of the URLs stay as they are, whatever their names. URLs are read whole at any length.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.tables import free_name

RULES_PER_TRIE = 1 << 18
RULE_CHARS = 1 << 12
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = str.maketrans(_UPPER, _LOWER)

# A node of the trie: children by host label, children by path segment, endings {last part of a path: verdict}.
_LABELS, _SEGMENTS, _ENDINGS = range(3)


def _rest(url: Column) -> Column:
    """What follows the first ``://`` (empty without one)."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z as a-z."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _lower(host: str) -> str:
    return host.translate(_TO_LOWER)


def _node() -> tuple[dict, dict, dict]:
    return {}, {}, {}


def trie(rules: Iterable[tuple[str, str, str | None]]) -> tuple:
    """The trie of (verdict, host, path) rules."""
    root = _node()
    for verdict, host, path in rules:
        path = path or ""
        if verdict not in (ALLOW, BLOCK) or not host or len(host) + len(path) > RULE_CHARS:
            raise ValueError(f"not a rule: {verdict!r}, {host!r}, {path!r}")
        node = root
        for label in reversed(_lower(host).split(".")):
            node = node[_LABELS].setdefault(label, _node())
        *whole, last = path.split("/")
        for segment in whole:
            node = node[_SEGMENTS].setdefault(segment, _node())
        if node[_ENDINGS].get(last) != BLOCK:
            node[_ENDINGS][last] = verdict
    return root


def _longest_path(node: tuple, path: str) -> tuple[str, str] | None:
    """(path, verdict) of the longest rule path below a host's node that ``path`` starts with."""
    best, at = None, 0
    while True:
        for end, verdict in node[_ENDINGS].items() if len(node[_ENDINGS]) < 4 else _endings(node, path[at:]):
            if path.startswith(end, at) and (best is None or at + len(end) >= len(best[0])):
                best = path[: at + len(end)], verdict
        cut = path.find("/", at)
        node = node[_SEGMENTS].get(path[at:cut]) if cut >= 0 else None
        if node is None:
            return best
        at = cut + 1


def _endings(node: tuple, rest: str):
    """The endings of a node with many, that ``rest`` starts with: looked up by length, not one by one."""
    ends = node[_ENDINGS]
    return [(rest[:n], ends[rest[:n]]) for n in range(min(len(rest), RULE_CHARS) + 1) if rest[:n] in ends]


def longest(root: tuple, host: str, path: str) -> tuple[str, str, str] | None:
    """(host, path, verdict) of the winning rule of a trie."""
    best, node = None, root
    labels = host.split(".") if host else []
    for i in range(len(labels) - 1, -1, -1):
        node = node[_LABELS].get(labels[i])
        if node is None:
            break
        found = _longest_path(node, path)
        if found:
            best = (".".join(labels[i:]), *found)
    return best


def _parts(df: DataFrame, rules: DataFrame | Iterable) -> list[list]:
    """The rules in lists of about ``RULES_PER_TRIE`` at most."""
    if not isinstance(rules, DataFrame):
        rules = sorted({(v, _lower(h or ""), p or "") for v, h, p in rules}, key=lambda r: (r[1:], r[0]))
        last = [r for r, after in zip(rules, [*rules[1:], None]) if not after or after[1:] != r[1:] or after[0] not in (ALLOW, BLOCK)]
        return [last[i : i + RULES_PER_TRIE] for i in range(0, len(last), RULES_PER_TRIE)]  # of an entry in both lists, block sorts last
    known = rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).distinct()
    n = -(-known.count() // RULES_PER_TRIE)
    part = F.pmod(F.xxhash64("host", "path"), F.lit(max(n, 1)))  # both verdicts of an entry meet in one trie
    return [[tuple(r) for r in known.filter(part == i).collect()] for i in range(n)]


def judge(df: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str | None]], url: str = "url", default: str = ALLOW, names: tuple[str, str, str, str] = ("host", "path", "rule", "verdict")) -> DataFrame:
    """``df`` with host, path, the winning rule (host and path; null without one) and the verdict of each URL.

    ``rules``: (verdict, host, path) tuples, or a DataFrame of these columns. Columns of ``df`` named as
    one of ``names`` are replaced.
    """
    spark = df.sparkSession
    found = free_name(df, "found")
    schema = "rhost string, rpath string, verdict string"
    source = F.col(f"`{url}`")
    host, path = host_of(source), path_of(source)
    out = df.withColumn(found, F.lit(None).cast(f"struct<{schema.replace(' ', ':')}>".replace(",:", ",")))

    def matcher(shared):
        @F.pandas_udf(schema)
        def match(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
            root = shared.value
            rows = [longest(root, h, p) or (None, None, None) for h, p in zip(hosts, paths)]
            return pd.DataFrame(rows, columns=["rhost", "rpath", "verdict"])

        return match

    for part in _parts(df, rules):
        new = matcher(spark.sparkContext.broadcast(trie(part)))(host, path)
        next_one = free_name(out, "next")
        out = out.withColumn(next_one, new)

        def size(c: str, field: str) -> Column:
            return F.coalesce(F.length(F.col(c)[field]), F.lit(-1))

        longer = (size(next_one, "rhost") > size(found, "rhost")) | ((size(next_one, "rhost") == size(found, "rhost")) & (size(next_one, "rpath") > size(found, "rpath")))
        out = out.withColumn(found, F.when(longer, F.col(next_one)).otherwise(F.col(found))).drop(next_one)
    rule = F.concat(F.col(found)["rhost"], F.col(found)["rpath"])
    made = dict(zip(names, (host, path, rule, F.coalesce(F.col(found)["verdict"], F.lit(default)))))
    return out.withColumns({f"__{name}": c for name, c in made.items()}).drop(*names, found).withColumnsRenamed({f"__{name}": name for name in names})
