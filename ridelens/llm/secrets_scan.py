"""Secret scans: multipart credential linking by an interval join of access identifiers, secrets and endpoints.

A credential often stands in parts: an access identifier, the secret that belongs to it and the endpoint it is for.
The identifier's form is telling; a secret (a long random-looking word) or an endpoint (a host) alone is a weak
candidate and most are harmless. Parts are found as intervals of the whole text; every access identifier opens a scope
of ``scope`` characters on both sides, and an interval join keeps a weak secret only if it overlaps a scope, and an
endpoint only if it shares a scope with a secret. Scopes never leave a document, so the join runs where the text is:
parts are sorted by start and each scope finds its parts by bisection; links name the nearest parts, never all pairs.
Assignments, access identifiers and long hexadecimal words are strong and always reported.

Lower bounds: a weak secret is a run of at least 32 base64 characters (no upper length; at most two ``=`` after it) with
lower case, upper case and digits and an entropy of 4 bits, so shorter ones and runs of URL-safe or other characters are
found only as assigned values or hexadecimal words. An endpoint is anything after a scheme (of 2 to 32 characters), an IP
address, ``localhost`` or a dotted ASCII name under any top-level domain of letters or in punycode; a single word or a
name in other letters is an endpoint only after a scheme.

Defined results: a null text is empty; positions are code points, end exclusive; repeated rows each get a row; a null
id stays null; other columns are ignored.
"""

from __future__ import annotations

import ipaddress
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in their order and the patterns of the strong kinds
KINDS = ("assign", "access", "hex", "secret", "endpoint")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a shorter run has no longer one inside, so the length can be in the pattern
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=])")
# a host: whatever follows a scheme, an IP address, localhost, a dotted name; then port and path. Dotted names outside
# the common domains are loose: many are file names or words about a full stop
LABELS = r"(?:[A-Z0-9][A-Z0-9-]*\.)+"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
V6 = rf"(?:[0-9A-F]{{0,4}}:){{2,7}}(?:(?:{OCTET}\.){{3}}{OCTET}|[0-9A-F]{{1,4}})?"
AFTER_SCHEME, TAIL = r"(?=[^\x00-\x2F\x3A-\x40\x5C-\x60\x7B-\x7F])", r"""[^\s"'<>]*"""
ENDPOINT = re.compile(rf"""https?://{AFTER_SCHEME}{TAIL} | (?<![A-Z0-9.-])(?:
    [A-Z][A-Z0-9+-]{{1,31}}://{AFTER_SCHEME}{TAIL}
    | {LABELS}(?:com|net|org|io|cloud|dev)(?![A-Z0-9_]){TAIL}
    | (?: (?:{OCTET}\.){{3}}{OCTET}(?![A-Z0-9_-]|\.[0-9])
        | \[(?P<v6>{V6})\] | (?P<bare>(?<!:){V6})(?![A-Z0-9_:-]|\.[A-Z0-9])
        | localhost(?![A-Z0-9_-]|\.[A-Z0-9])
        | (?P<loose>{LABELS}(?:xn--[A-Z0-9-]+|[A-Z]{{2,63}})(?![A-Z0-9_]|://))
      )(?::[0-9]+(?!\.?[A-Z0-9-]))?(?:[/?\#]{TAIL})? )""", re.IGNORECASE | re.ASCII | re.VERBOSE)
MIN_ASSIGN, MIN_ACCESS, MIN_ENTROPY = 6, 20, 4.0

Span = tuple[int, int]


def strong_spans(text: str) -> dict[str, list[Span]]:
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGN],
        "access": [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
        if "AKIA" in text else [],
        "hex": [m.span() for m in HEX.finditer(text)],
    }


def looks_random(word: str) -> bool:
    """Lower, upper case and digits, and the entropy of its letters is high."""
    counts = Counter(word)
    entropy = -sum(c / len(word) * math.log2(c / len(word)) for c in counts.values())
    return (entropy >= MIN_ENTROPY and any(c.islower() for c in word) and any(c.isupper() for c in word)
            and any(c.isdigit() for c in word))


def in_scope(parts: list[Span], a: int, z: int, longest: int) -> list[Span]:
    """The sorted parts that overlap [a, z); ``longest`` is the length of the longest part."""
    lo, hi = bisect_left(parts, (a - longest + 1, 0)), bisect_left(parts, (z, 0))
    return [p for p in parts[lo:hi] if p[1] > a]


def in_scope_disjoint(parts: list[Span], a: int, z: int) -> list[Span]:
    """The same of sorted parts that do not overlap each other, however long one is."""
    lo, hi = bisect_left(parts, (a, 0)), bisect_left(parts, (z, 0))
    return parts[lo - (lo > 0 and parts[lo - 1][1] > a):hi]


def find_hosts(text: str) -> tuple[list[Span], set[Span]]:
    """The hosts in order, and which of them are loose."""
    hosts, loose, at = [], set(), 0
    while m := ENDPOINT.search(text, at):
        at = m.end()
        if (word := m["v6"] or m["bare"]) and not _is_ipv6(word):
            at = m.start() + 1
            continue
        hosts.append(m.span())
        if m["loose"]:
            loose.add(m.span())
    return hosts, loose


def _is_ipv6(word: str) -> bool:
    try:
        return word.strip(":") != "" and bool(ipaddress.IPv6Address(word))
    except ValueError:
        return False


def _nearest(parts: list[Span], at: Span) -> Span | None:
    return min(parts, key=lambda p: (max(p[0] - at[1], at[0] - p[1]), p), default=None)


def link_parts(text: str, strong: dict[str, list[Span]], scope: int) -> tuple[dict[str, list[Span]], list[dict]]:
    """Weak candidates that a scope confirms, and a link (access, secret, endpoint) per access identifier."""
    taken = sorted(s for spans in strong.values() for s in spans)
    longest = max((z - a for a, z in taken), default=0)
    free = [m.span() for m in WEAK_SECRET.finditer(text) if looks_random(m.group())]
    free = [s for s in free if not in_scope(taken, *s, longest)]
    hosts, loose = find_hosts(text)
    # what can be a secret of an access identifier: weak ones and values that are assigned or hexadecimal
    known = sorted([*strong["assign"], *strong["hex"]])
    longest_known = max((z - a for a, z in known), default=0)
    secrets, endpoints, links = set(), set(), []
    for access in strong["access"]:
        a, z = access[0] - scope, access[1] + scope
        weak = in_scope_disjoint(free, a, z)
        any_secret = [*weak, *in_scope(known, a, z, longest_known)]
        near = in_scope_disjoint(hosts, a, z) if any_secret else []
        secrets.update(weak)
        endpoints.update(near)
        # a loose host, which may be no host, is linked only if there is no other
        secret, endpoint = _nearest(any_secret, access), _nearest([h for h in near if h not in loose] or near, access)
        if secret:
            links.append({"access_start": access[0], "secret_start": secret[0],
                          "endpoint_start": endpoint[0] if endpoint else None})
    return {"secret": sorted(secrets), "endpoint": sorted(endpoints)}, links


def span_text(spans: dict[str, list[Span]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    flat = sorted((a, KINDS.index(k), z) for k, v in spans.items() for a, z in v)
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in flat)


def _scan(scope: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"].array, pdf["text"].array, strict=True):
                text = text if isinstance(text, str) else ""
                strong = strong_spans(text)
                weak, links = link_parts(text, strong, scope) if strong["access"] else ({}, [])
                rows.append((None if i is None else int(i), *(len(strong[k]) for k in KINDS[:3]),
                             span_text(strong), span_text(strong | weak), links))
            out = pd.DataFrame(rows, columns=["id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "links"])
            yield out.assign(id=pd.array([r[0] for r in rows], "Int64"))

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """Per row: id, counts of the strong kinds, base_spans and all spans as text, links of multipart credentials."""
    # ids go as text: pandas would turn a column of integers and nulls into floats
    base = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), F.col(text_col).alias("text"))
    return base.mapInPandas(
        _scan(scope),
        "id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, "
        "links array<struct<access_start:int,secret_start:int,endpoint_start:int>>",
    ).withColumnRenamed("id", id_col)


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    from ridelens.llm.common import documents

    out = scan_secrets(documents(spark, sf_dir))
    return out.select("doc_id", "n_assign", "n_access", "n_hex",
                      F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans")
