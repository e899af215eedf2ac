"""Personal data by anchor expansion: one Aho-Corasick pass finds anchors, small parsers expand and validate each.

Anchors are at-signs (email), a digit before a full stop (ip), two digits with at most one space or hyphen between (card),
a plus sign before a digit (phone), schemes (url) and identifier cues such as ``account`` (account). For each kind the spans
are the leftmost matches that do not overlap, in code points with an exclusive end. After a cue stands a number, a passport's
letters and digits, or an IBAN, which must have its country's length and pass its check.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import table
from tidepanel.llm.span_sql import PLAIN, WHOLE, matches_sql

#: In the order that breaks ties of start.
KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE_KINDS = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://")
CUES = tuple(v for w in ("account", "acct", "iban", "ssn", "passport") for v in (w, w.capitalize(), w.upper()))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A URL does not end with a mark that ends a sentence.
_URL = re.compile(r"(?:https?|ftp)://[A-Za-z0-9](?:[A-Za-z0-9._~:/?#@!$&*+,;=%-]*[A-Za-z0-9_~/#@$&*+=%-])?")
#: What stands between a cue and its identifier: marks, and words such as ``number`` or ``No.``.
_LEAD = re.compile(r"(?:[ \t:#.=-]{0,3}(?:number|num|no|nr|code|id|is)\b){0,3}[ \t:#.=-]{1,3}", re.IGNORECASE)
_NUMBER = re.compile(r"[0-9][0-9-]{4,}[0-9][A-Za-z0-9]*")
_PASSPORT = re.compile(r"(?=(?:[A-Za-z]{0,5}[0-9]){4})[A-Za-z0-9]{6,9}(?![^\W_])")
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30}")
_IBAN_SIZES = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 "
    "HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 "
    "SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()}  # fmt: skip


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban(value: str) -> bool:
    """Whether ASCII letters and digits are an IBAN: of its country's length, where that is known, and of remainder 1 by 97."""
    if not 15 <= len(value) <= 34 or _IBAN_SIZES.get(value[:2].upper(), len(value)) != len(value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _run_start(text: str, at: int, least: int, allowed: frozenset[str]) -> int:
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


# Each parser gets the text, where the anchor begins and ends, and where the last match of its kind ended. It returns
# (start, end of what it has consumed, span or None), or None if nothing matches here.


def _email(text, begin, end, last):
    start = _run_start(text, begin, last, _LOCAL)
    domain = _DOMAIN.match(text, end) if start < begin else None
    return domain and (domain.end(), (start, domain.end()))


def _ip(text, begin, end, last):
    found = _IP.match(text, _run_start(text, begin, last, _DIGITS))
    if found is None:
        return None
    parts = [x.lstrip("0") for x in found[0].split(".")]
    good = all(len(x) <= 3 and int(x or 0) <= 255 for x in parts)
    return found.end(), (found.span() if good else None)


def _card(text, begin, end, last):
    found = _CARD.match(text, begin)
    digits = found[0].replace(" ", "").replace("-", "") if found.end() - begin < 60 else ""
    return found.end(), (found.span() if 14 <= len(digits) <= 19 and luhn(digits) else None)


def _phone(text, begin, end, last):
    found = _PHONE.match(text, begin)
    return found and (found.end(), (found.span() if 10 <= sum(c in _DIGITS for c in found[0]) <= 15 else None))


def _url(text, begin, end, last):
    found = _URL.match(text, begin)
    return found and (found.end(), found.span())


def _iban_end(text: str, begin: int) -> int | None:
    """Where the longest valid IBAN that begins here and stops at a boundary ends."""
    found = _IBAN.match(text, begin)
    for end in range(found.end(), begin + 14, -1) if found else ():
        if text[end - 1].isalnum() and not text[end : end + 1].isalnum() and iban(text[begin:end].replace(" ", "").replace("-", "")):
            return end
    return None


def _account(text, begin, end, last):
    lead = _LEAD.match(text, end)
    if lead is None:
        return None
    start = lead.end()
    if stop := _iban_end(text, start):
        return stop, (start, stop)
    found = _NUMBER.match(text, start) or (_PASSPORT.match(text, start) if text[begin:end].lower() == "passport" else None)
    return found and (found.end(), found.span())


_PARSERS = (_email, _ip, _card, _phone, _url, _account)


def _anchors() -> ahocorasick.Automaton:
    digits = sorted(_DIGITS)
    kinds = {"@": 0} | {f"{d}.": 1 for d in digits} | {a + s + b: 2 for a in digits for b in digits for s in ("", " ", "-")} | {f"+{d}": 3 for d in digits}
    kinds |= dict.fromkeys(SCHEMES, 4) | dict.fromkeys(CUES, 5)
    out = ahocorasick.Automaton()
    for word, kind in kinds.items():
        out.add_word(word, (len(word), kind))
    out.make_automaton()
    return out


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """Spans (start, kind number, end) of one text, sorted."""
    last, found = [0] * len(KINDS), []
    for at, (size, kind) in anchors.iter(text):
        begin = at + 1 - size
        if begin < last[kind]:
            continue
        hit = _PARSERS[kind](text, begin, at + 1, last[kind])
        if hit:
            last[kind] = hit[0]
            if hit[1]:
                found.append((hit[1][0], kind, hit[1][1]))
    found.sort()
    return found


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or each run of overlapping spans, replaced by the kind of its first."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join((*out, text[at:])) if out else text


_SPANS = "spans array<struct<kind:string,start:long,end:long>>"


def _scan(redacting: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = _anchors()
        kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = batch.column("text")
            out, spans = [], []
            for value in texts:
                text = value.as_py()
                found = find_spans(text, anchors) if text else []
                if redacting:
                    out.append(redact(text, found) if found else text)
                spans.append([{"kind": KINDS[k], "start": b, "end": e} for b, k, e in found])
            rest = [(c, batch.column(c)) for c in batch.schema.names if c != "text"]
            columns = [*rest, *([("text", pa.array(out, pa.string()))] if redacting else []), ("spans", pa.array(spans, kind_type))]
            yield pa.RecordBatch.from_arrays([c for _, c in columns], [k for k, _ in columns])

    return run


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, spans), one for each row of ``docs``; spans are structs (kind, start, end) by start, then kind.

    Null and empty texts have no spans; very long ones are scanned whole. Ids may be null or repeat; each row is scanned by
    itself, so repeated rows have equal spans. Of spans that begin together the kind listed first comes first. An empty table
    gives no rows; other columns are not read, so their names can't clash.
    """
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan(False), f"id {kind}, {_SPANS}")


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every personal span of the text replaced by its kind in brackets; other texts stay as they are.

    Null texts stay null and empty ones empty; very long ones are redacted whole. All other columns pass through, whatever
    their names; repeated rows and ids stay as they are, and an empty table gives no rows.
    """
    others = [c for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest"), F.col(text_col).alias("text"))
    kind = packed.schema["rest"].dataType.simpleString()
    out = packed.mapInArrow(_scan(True), f"rest {kind}, text string, {_SPANS}")
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns))


def joined_spans(spans, kinds=None):
    """``kind:start:end`` comma-joined."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; nulls, empty and long texts, ties and repeats as in ``find_pii``."""
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [count_of(F.col("spans"), k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined_spans(F.col("spans"), BASE_KINDS), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


_CUE_PATTERN = "|".join(CUES)
_PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", WHOLE),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", WHOLE),
    ("card", r"[0-9]([\x20-]?[0-9])+", WHOLE),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", WHOLE),
    ("url", r"(https?|ftp)://[A-Za-z0-9]([A-Za-z0-9._~:/?#@!$&*+,;=%-]*[A-Za-z0-9_~/#@$&*+=%-])?", WHOLE),
    ("account", rf"((?:{_CUE_PATTERN})[\x20:#.=-]{{1,3}})([0-9][0-9-]{{4,32}}[0-9])", "'\\1' || chr(1) || '\\2' || chr(2)"),
]
ORACLE = f"""
WITH d AS ({PLAIN}), {matches_sql(_PATTERNS, "d")}, g AS (
  SELECT *, regexp_replace(s, '[^0-9]', '', 'g') AS n FROM found
), ok AS (
  SELECT doc_id, kind, o, b, e FROM g WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(s, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(ltrim(x, '0'), 3) AS INT) > 255)) = 0
    WHEN 'phone' THEN length(n) BETWEEN 10 AND 15
    WHEN 'card' THEN length(n) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda i:
      CASE WHEN (length(n) - i) % 2 = 0 THEN CAST(n[i] AS INT) WHEN CAST(n[i] AS INT) > 4 THEN 2 * CAST(n[i] AS INT) - 9 ELSE 2 * CAST(n[i] AS INT) END)) % 10 = 0
    ELSE true END
)
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
  count(*) FILTER (kind = 'phone') AS n_phone,
  sha256(coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) FILTER (o < 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN ok USING (doc_id) GROUP BY d.doc_id
"""
