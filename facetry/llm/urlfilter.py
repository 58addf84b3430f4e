"""URL filters: a trie over reversed host labels and path segments.

Each rule is ``(verdict, host, path)``. The host part of the trie is keyed by labels
from the right, so a rule also fits all subdomains; each host node with rules carries
a second trie over path segments. A rule's last segment need not be whole: it fits
any segment that starts with it, so a rule fits exactly the paths that start with its
own. Of the rules that fit, that with more host labels wins, then that with the longer
path, then ``block``; a url without one gets the filter's default verdict.

Edge cases: null urls and urls without ``://`` have an empty host and path and get the
default; repeated rows give repeated results; very long urls are read whole; empty tables give empty results;
further columns are ignored. Of rules that tie in labels and path, block wins. The rules
are broadcast and made a trie once a worker, so lists over ``max_rules`` are refused.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame

from facetry.llm.common import arrow_map

#: The rules of the query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PARTS = re.compile(r"\A.*?://([^/?#]*)([^?#]*)", re.DOTALL)


def split_url(url: str | None) -> tuple[str, str]:
    """Lower-cased host and path; both empty for null or without ``://``."""
    found = _PARTS.match(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


#: The trie that this worker made last.
_TRIES: dict[str, _Node] = {}


class _Node:
    __slots__ = ("below", "paths", "here")

    def __init__(self) -> None:
        self.below: dict[str, _Node] = {}
        self.paths: _Node | None = None
        self.here: list[tuple[str, str, str]] = []


def compile_rules(rules, max_rules: int = 1_000_000) -> _Node:
    """The trie of ``(verdict, host, path)`` rules."""
    rules = list(rules)
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; a filter that tasks hold has at most {max_rules}")
    root = _Node()
    for verdict, host, path in rules:
        node = root
        host = host.translate(_LOWER)
        for label in reversed(host.split(".")) if host else ():
            node = node.below.setdefault(label, _Node())
        node.paths = node.paths or _Node()
        *whole, last = path.split("/")
        place = node.paths
        for segment in whole:
            place = place.below.setdefault(segment, _Node())
        place.here.append((last, verdict, host + path))
    return root


def judge(root: _Node, host: str, path: str, default: str = "allow") -> tuple[str | None, str]:
    """The rule that wins and the verdict."""
    nodes, node = [root], root
    for label in reversed(host.split(".")) if host else ():
        node = node.below.get(label)
        if node is None:
            break
        nodes.append(node)
    segments = path.split("/")
    for node in reversed(nodes):
        if node.paths is None:
            continue
        places, place = [], node.paths
        for depth, segment in enumerate(segments):
            places.append((place, depth))
            place = place.below.get(segment)
            if place is None:
                break
        for place, depth in reversed(places):
            fits = [(len(last), verdict == "block", rule, verdict) for last, verdict, rule in place.here if segments[depth].startswith(last)]
            if fits:
                return max(fits)[2:]
    return None, default


def filter_urls(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row."""
    compile_rules(rules)  # refuses lists that are too long before anything is sent
    name, held = uuid.uuid4().hex, pages.sparkSession.sparkContext.broadcast(tuple(rules))

    def work(batch: pa.RecordBatch) -> dict:
        if name not in _TRIES:
            _TRIES.clear()
            _TRIES[name] = compile_rules(held.value)
        root = _TRIES[name]
        parts = [split_url(x) for x in batch.column("url").to_pylist()]
        said = [judge(root, host, path, default) for host, path in parts]
        return {"page_id": batch.column("page_id"), "host": [x[0] for x in parts], "path": [x[1] for x in parts], "rule": [x[0] for x in said], "verdict": [x[1] for x in said]}

    return arrow_map(pages.select("page_id", "url"), work, "page_id long, host string, path string, rule string, verdict string")
