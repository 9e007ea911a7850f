from __future__ import annotations

import hashlib
import re

import pytest

from ridelens.llm import secrets_scan as S
from ridelens.llm.secrets_scan import op3_secret_scan
from tests.llm.conftest import SF

SECRET = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzEXAMPLEKEY"
ACCESS = "AKIA" + "Q7" * 8


def brute(text):
    text = text or ""
    kinds = {
        "assign": [m for m in re.finditer(
            r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"
            r"[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6],
        "access": [m for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        "hex": [m for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24],
    }
    flat = sorted((m.start(), k, n, m.end()) for k, (n, ms) in enumerate(kinds.items()) for m in ms)
    line = ",".join(f"{n}:{a}:{z}" for a, _, n, z in flat)
    return [len(ms) for ms in kinds.values()], hashlib.sha256(line.encode()).hexdigest()


PLANTED = [
    "api_key='abcdef' APIKEY:123456 password = \"short\" Token=abc paſsword=longsff toKen=longenough",
    f"{ACCESS} then {SECRET}", "deadbeef" * 4 + " " + "0" * 23 + " AKIA AKIAAKIA" + "B" * 20, "secret:=x secret==abcdefg",
    "\U0001F600 passwd: abcdefgh", "AKIA" + "A" * 15, "password=" * 3 + "abcdefg",
]


def test_base_spans(spark, small):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(PLANTED)], "doc_id long, text string")
    docs = docs.union(spark.createDataFrame([(1000 + i, t) for i, t in small], "doc_id long, text string"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in S.scan_secrets(docs).collect():
        counts, sha = brute(text[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts
        assert hashlib.sha256(r["base_spans"].encode()).hexdigest() == sha
        assert set(filter(None, r["base_spans"].split(","))) <= set(r["spans"].split(","))
    assert op3_secret_scan(spark, SF).count() == len(small)


def kinds(text, scope=200):
    strong = S.strong_spans(text)
    weak, links = S.link_parts(text, strong, scope) if strong["access"] else ({}, [])
    return [s.split(":")[0] for s in S.span_text(strong | weak).split(",") if s], links


@pytest.mark.parametrize(("text", "want", "n_links"), [
    (f"key {SECRET} at https://s3.example.com/b", [], 0),  # weak parts alone stay silent
    (f"{ACCESS} at https://s3.example.com/b", ["access"], 0),  # an endpoint needs a secret beside it
    (f"{ACCESS} {SECRET}", ["access", "secret"], 1),
    (f"{ACCESS} {SECRET} https://s3.example.com/b", ["access", "secret", "endpoint"], 1),
    (f"{ACCESS} {'.' * 300} {SECRET}", ["access"], 0),  # out of scope
    (f"{ACCESS} password=hunter22 s3.example.com", ["access", "assign", "endpoint"], 1),
    (f"{ACCESS} {'z' * 40}", ["access"], 0),  # long but not random
    (f"{SECRET} {ACCESS} x {ACCESS}", ["secret", "access", "access"], 2),
])
def test_linking(text, want, n_links):
    got, links = kinds(text)
    assert got == want and len(links) == n_links


LONG = "".join(f"{SECRET[k:]}x{k}Q/" for k in range(0, 20, 4))[:86] + "=="


@pytest.mark.parametrize("secret", [LONG, LONG[:86] * 5])
def test_long_secrets_are_found_whole(secret):
    text = f"{ACCESS} {secret} https://s3.example.com/b"
    strong = S.strong_spans(text)
    weak, links = S.link_parts(text, strong, 200)
    at = len(ACCESS) + 1
    assert weak["secret"] == [(at, at + len(secret))] and [li["secret_start"] for li in links] == [at]


@pytest.mark.parametrize("host", [
    "s3.example.de", "https://minio.example.co.uk/b", "S3.EXAMPLE.COM", "HTTPS://Store.Example.Com/b", "10.0.0.5:9000",
    "http://192.168.1.7/b", "localhost:9000", "http://minio:9000/b", "s3://bucket/key", "[2001:db8::5]:443", "fe80::1",
    "https://user@store.example.fr/b", "xn--bcher-kva.xn--p1ai", "https://münchen.de/x", "s3.example.com"])
def test_any_host_form_is_an_endpoint(host):
    text = f"{ACCESS} {SECRET} {host} end"
    weak, links = S.link_parts(text, S.strong_spans(text), 200)
    at = text.index(host)
    found = [(a, z) for a, z in weak["endpoint"] if z == at + len(host)]
    assert found and text[found[0][0]:at] == "" and links[0]["endpoint_start"] == found[0][0], (host, weak)
    assert kinds(f"{SECRET} {host}") == ([], [])  # without an access identifier it stays silent


def test_no_host_in_times_and_numbers():
    assert kinds(f"{ACCESS} {SECRET} at 12:30:45 v1.2.3 300.1.1.1 e.g. a:b :: x")[0] == ["access", "secret"]


@pytest.mark.parametrize("before", ["12:30:45,", "file.txt,", "a.", "end.Start(", "10.0.0.1;", "url:"])
def test_other_forms_do_not_swallow_a_host(before):
    text = f"{ACCESS} {SECRET} {before}https://s3.example.com/b"
    weak, links = S.link_parts(text, S.strong_spans(text), 200)
    assert (text.index("https"), len(text)) in weak["endpoint"], weak


def test_links_prefer_hosts_that_are_sure():
    text = f"{ACCESS} config.yaml password=abc.defgh {SECRET} https://s3.example.com/b"
    weak, links = S.link_parts(text, S.strong_spans(text), 200)
    assert text[links[0]["endpoint_start"]:].startswith("https://") and len(weak["endpoint"]) == 3


def test_interval_join_is_exact():
    import random
    rng = random.Random(3)
    parts = sorted((a, a + rng.randint(1, 30)) for a in rng.sample(range(500), 60))
    longest = max(z - a for a, z in parts)
    for _ in range(200):
        a = rng.randint(-20, 520)
        z = a + rng.randint(1, 60)
        assert S.in_scope(parts, a, z, longest) == [p for p in parts if p[0] < z and p[1] > a]


def test_interval_join_of_disjoint_parts_is_exact():
    import random
    rng = random.Random(4)
    at = sorted(rng.sample(range(500), 80))
    parts = list(zip(at[::2], at[1::2], strict=True))
    for _ in range(300):
        a = rng.randint(-20, 520)
        z = a + rng.randint(1, 60)
        assert S.in_scope_disjoint(parts, a, z) == [p for p in parts if p[0] < z and p[1] > a]


def test_edges(edge_docs, edge_rows, no_docs):
    got = S.scan_secrets(edge_docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted(
        (r[0] is None, r[0] or 0) for r in edge_rows)
    assert S.scan_secrets(no_docs).count() == 0
