"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from siteloom.llm.common import documents, fresh, map_texts, sha

Span = tuple[int, int]
#: Characters before and after a span in which context words count.
CONTEXT_CHARS = 48
#: A span of an added kind is kept from this score on; base kinds always are.
THRESHOLD = 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_IMEI = re.compile(r"(?<![0-9])[0-9]{15}(?![0-9])")
_GROUPED = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064: the first four characters moved to the end, letters as 10 to 35, leave 1."""
    rest = 0
    for c in code[4:] + code[:4]:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return rest == 1


def emails(text: str) -> Iterator[Span]:
    """Each run before an @ is looked at once, from the @ back, so long runs cost no more than their length."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = at = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            done = m.end()


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[Span]:
    """The longest start of the run, cut at its blanks, that passes mod-97."""
    for m in _IBAN.finditer(text):
        run = m[0]
        while len(run.replace(" ", "")) >= 15:
            if mod97(run.replace(" ", "")):
                yield m.start(), m.start() + len(run)
                break
            run = run.rpartition(" ")[0]


def imeis(text: str) -> Iterator[Span]:
    return (m.span() for m in _IMEI.finditer(text) if luhn(m[0]))


def grouped_ids(text: str) -> Iterator[Span]:
    return (m.span() for m in _GROUPED.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000")


@dataclass(frozen=True)
class Kind:
    name: str
    find: Callable[[str], Iterator[Span]]
    score: float  # without context; what a checksum confirms starts higher
    base: bool
    near: tuple[str, ...]  # whole words that raise the score, in four languages
    against: tuple[str, ...] = ()  # whole words that lower it


KINDS = (
    Kind("email", emails, 0.9, True, ("mail", "email", "e-mail", "mailto", "contact", "kontakt", "correo", "courriel")),
    Kind("ip", ips, 0.6, True, ("ip", "ipv4", "address", "host", "server", "adresse"), ("version", "release")),
    Kind("card", cards, 0.8, True, ("card", "visa", "credit", "karte", "kreditkarte", "carte", "tarjeta"), ("order", "serial")),
    Kind("phone", phones, 0.7, True, ("phone", "telephone", "call", "tel", "mobile", "telefon", "numéro", "teléfono")),
    Kind("iban", ibans, 0.9, False, ("iban", "account", "bank", "konto", "compte", "cuenta")),
    Kind("imei", imeis, 0.4, False, ("imei", "device", "handset", "gerät")),
    Kind("ssn", grouped_ids, 0.4, False, ("ssn", "social security", "taxpayer"), ("part", "order")),
)


def _words(words: tuple[str, ...]) -> re.Pattern | None:
    return re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, words))})s?(?!\w)") if words else None


_CONTEXT = {k.name: (_words(k.near), _words(k.against)) for k in KINDS}


def _weight(pattern: re.Pattern | None, before: str, after: str) -> float:
    """0 without a word of the context, else 0.2 to 0.35, the nearer to the span the more."""
    if not pattern:
        return 0.0
    gaps = [len(before) - m.end() for m in pattern.finditer(before)] + [m.start() for m in pattern.finditer(after)]
    return 0.2 + 0.15 * (1 - min(gaps) / CONTEXT_CHARS) if gaps else 0.0


def _edge(text: str, at: int, step: int) -> int:
    """CONTEXT_CHARS on from a place, less a word that would be cut there."""
    end = min(max(0, at + step * CONTEXT_CHARS), len(text))
    inside = 0 < end < len(text) and (text[end - 1].isalnum() and text[end].isalnum())
    while inside and end != at and text[end - (step > 0)].isalnum():
        end -= step
    return end


def scored(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind as listed, then start; added kinds only from THRESHOLD on."""
    out = []
    for kind in KINDS:
        near, against = _CONTEXT[kind.name]
        for start, end in kind.find(text):
            before, after = text[_edge(text, start, -1) : start].lower(), text[end : _edge(text, end, 1)].lower()
            score = kind.score + _weight(near, before, after) - _weight(against, before, after)
            if kind.base or score >= THRESHOLD:
                out.append((kind.name, start, end, round(min(1.0, max(0.0, score)), 2)))
    return out


def redact(text: str, threshold: float = 0.0) -> str:
    """text with each span of at least this score replaced by its kind in brackets; of overlapping
    spans the earlier, then longer one is replaced and the rest of the others is removed with it."""
    parts, at = [], 0
    for start, name, end in sorted((s, n, e) for n, s, e, p in scored(text) if p >= threshold):
        if start >= at:
            parts += [text[at:start], f"[{name.upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:] if parts else text


def pii_spans(df: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """id_cols, found array<struct<kind,start,end,score>> of every whole text.

    Offsets are code points, ends exclusive. A null or empty text has no spans; repeated rows stay;
    an empty table gives an empty one. All searches are linear in the length of the text.
    """
    schema = "found array<struct<kind:string,start:long,end:long,score:double>>"
    return map_texts(df, id_cols, text_col, schema, lambda: lambda texts: {"found": [[dict(zip(("kind", "start", "end", "score"), s)) for s in scored(t)] for t in texts]})


def redacted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the spans of its texts replaced by their kinds; a null text stays null. Same columns, same rows."""
    keep = [c for c in df.columns if c != text_col]
    none, new = fresh(df.columns, "__none"), fresh(df.columns, "__new")
    made = map_texts(df.withColumn(none, F.col(text_col).isNull()), [*keep, none], text_col, f"`{new}` string", lambda: lambda texts: {new: [redact(t) for t in texts]})
    return made.select(*[(F.when(~F.col(none), F.col(new)).alias(c) if c == text_col else F.col(c)) for c in df.columns])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document, as pii_spans finds them; a null, empty or very long text, repeated rows and an empty table: see there."""

    def work(texts):
        out: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores")}
        for text in texts:
            found = scored(text)
            base = [x for x in found if x[0] in ("email", "ip", "card", "phone")]
            written = lambda xs: ",".join(f"{n}:{s}:{e}" for n, s, e, _ in xs)
            for name in ("email", "ip", "card", "phone"):
                out[f"n_{name}"].append(sum(x[0] == name for x in base))
            out["base_sha256"].append(sha(written(base)))
            out["spans"].append(written(found))
            out["scores"].append(",".join(f"{x[3]:.2f}" for x in found))
        return out

    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"
    return map_texts(documents(spark, sf_dir), ["doc_id"], "text", schema, lambda: work)
