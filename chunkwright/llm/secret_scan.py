"""Secrets: known patterns, and strings that a tokenizer's vocabulary needs many tokens for.

A tokenizer spends few tokens on words and names and many on random characters. Long strings of key
characters whose characters-per-token ratio is low are reported, unless they are digests, identifiers
or lie within a span of the known patterns.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

from . import common

#: The base patterns and their order.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: A candidate: key characters, at least MIN_LENGTH of them, with a letter.
MIN_LENGTH = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_LENGTH)
#: Fewer characters a token than this is random; words of any language lie above 2.5.
MAX_RATIO = 2.1

#: Identifiers and digests that aren't secrets: UUIDs, digests of the usual lengths in either case, numbers,
#: dates with times, paths, and after a digest's name what has a digest's form and length.
KNOWN = re.compile(
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
    r"|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128}"
    r"|(?:md5|sha1|sha224|sha256|sha384|sha512)-[A-Za-z0-9+/_-]+={0,2}"
    r"|[0-9+/_=-]+"
    r"|/?(?:[A-Za-z]+[/_-])+[A-Za-z]*"
)
DIGEST_NAME = re.compile(r"(?i:md5|sha1|sha224|sha256|sha384|sha512|digest|checksum|etag|commit|integrity)\W{1,3}$", re.A)
DIGEST = re.compile(
    r"(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})(?:-[0-9]+)?"
    r"|[A-Za-z0-9+/_-]{22}(?:==)?|[A-Za-z0-9+/_-]{27}=?|[A-Za-z0-9+/_-]{38}(?:==)?|[A-Za-z0-9+/_-]{43}=?|[A-Za-z0-9+/_-]{64}|[A-Za-z0-9+/_-]{86}(?:==)?"
)


@functools.cache
def encoding(path: str):  # noqa: ANN201
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def lettered(text: str) -> bool:
    """Has a letter: a number has none."""
    return any(c.isalpha() for c in text)


def merged(spans: dict[str, list[tuple[int, int]]]) -> list[list[int]]:
    """The union of all spans, in order: overlapping ones are one."""
    out: list[list[int]] = []
    for start, end in sorted(x for got in spans.values() for x in got):
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def find(text: str, vocabulary: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order of their start; a random span overlaps none of the base kinds."""
    spans: dict[str, list[tuple[int, int]]] = {}
    for m in ASSIGN.finditer(text):
        if len(m[1]) >= 6:
            spans.setdefault("assign", []).append(m.span())
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        if got := [m.span() for m in pattern.finditer(text)]:
            spans[kind] = got
    base, at = merged(spans), 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][1] <= start:
            at += 1
        if not lettered(m[0]) or at < len(base) and base[at][0] < end:
            continue
        if KNOWN.fullmatch(m[0]) or DIGEST.fullmatch(m[0]) and DIGEST_NAME.search(text, max(0, start - 16), start):
            continue
        if len(m[0]) < MAX_RATIO * len(encoding(vocabulary).encode_ordinary(m[0])):
            spans.setdefault("random", []).append((start, end))
    return spans


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    rows = sorted((start, place, end, kind) for place, kind in enumerate(kinds) for start, end in spans.get(kind, ()))
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in rows)


def secret_spans(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ``kind``, ``start``, ``end``, ``value``: one row for each span.

    A null or empty text has no spans. Rows are taken one by one: repeated rows give repeated results, null
    ids stay null, other columns are ignored. No shuffle.
    """
    vocabulary = vocabulary or default_vocabulary()

    def rows(batch: list) -> Iterable[tuple]:
        for doc_id, text in batch:
            for kind, spans in find(text or "", vocabulary).items():
                for start, end in spans:
                    yield doc_id, kind, start, end, text[start:end]

    return common.map_rows(docs.select("doc_id", "text"), rows, "doc_id long, kind string, start long, end long, value string")


def secret_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row a document: counts of the base kinds, a digest of the base spans and all spans as text.

    A null or empty text has no spans and the digest of the empty string. Rows are taken one by one:
    repeated rows give repeated results, null ids stay null, other columns are ignored. No shuffle.
    """
    vocabulary = vocabulary or default_vocabulary()

    def rows(batch: list) -> Iterable[tuple]:
        for doc_id, text in batch:
            spans = find(text or "", vocabulary)
            yield doc_id, *(len(spans.get(k, ())) for k in BASE), hashlib.sha256(listed(spans, BASE).encode()).hexdigest(), listed(spans, KINDS)

    return common.map_rows(docs.select("doc_id", "text"), rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str, vocabulary: str, mark: str = "[SECRET]") -> str:
    """``text`` with each span, or union of overlapping spans, replaced by ``mark``."""
    out, done = [], 0
    for start, end in merged(find(text, vocabulary)):
        out += [text[done:start], mark]
        done = end
    return "".join([*out, text[done:]])
