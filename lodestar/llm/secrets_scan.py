"""Secret scans: patterns, and zstandard novelty against a primed dictionary.

Base spans come from patterns.  A further candidate is a token in a sensitive
context that is no plain word or identifier: one with a digit, or whose case
changes at every third character or more often.  Its
novelty is the marginal cost of writing it after what surrounds it: the
compressor is primed with common identifiers and the text around the candidate,
and the bytes of the frame beyond an empty one's are set against what random
characters of the candidate's own alphabet would need, so that a long secret of
few characters, hexadecimal ones say, counts as much as a short one of many.  What
the dictionary cannot shorten is reported.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
MIN_CANDIDATE = 12
CONTEXT_CHARS = 256
NEAR_CHARS = 40
MIN_NOVELTY = 0.85
LEVEL = 3
CODE_TABLE = 16  # bytes of an entropy coder's table

# fixed values: identifiers that code and configuration share
IDENTIFIERS = """
access account address admin algorithm api application archive argument array async attribute auth authorization await
backend base64 bearer bool branch bucket buffer build byte cache callback certificate channel class client cluster column
commit component config connection const container content context controller cookie count credential cursor data database
dataset date debug default delete deploy description destination development device dictionary directory document domain
double element enabled encoding endpoint engine entity environment error event example exception export extends false
feature field file filter float folder format frame function handler hash header host hostname http https identifier image
import index info input insert instance int integer interface internal item iterator job json key label language length
level library limit line link list listener loader local location log logger login long main manager map master matcher
member memory message metadata method metric middleware migration mode model module monitor mount name namespace network
node none null number object offset operation option order output owner package page parameter parent parse parser
partition password patch path pattern payload permission pipeline platform plugin pointer policy port position post prefix
private process producer production profile program project property protocol provider proxy public publish query queue
random range read record redirect reference region register release remote render replica repository request require
resource response result return role root route router row runtime sample scheduler schema scope script search secret
section select self sender sequence serializer server service session set setting shard signature size snapshot socket
source space stack stage start state static status storage store stream string struct subscription suffix system table
target task template tenant test text thread timeout timestamp token topic trace transaction transfer transform true type
undefined unique update upload url user username utils uuid validate value variable version view virtual void volume
warning webhook width window worker workspace write
""".split()

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CANDIDATE)
_SENSITIVE = re.compile(r"passw|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|authorization|AKIA", re.IGNORECASE | re.ASCII)
_DIGIT, _ALPHA = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
_TURN = re.compile(r"(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")
# fixed values: alphabets of secrets, the smallest first, by pattern and bits a character
_ALPHABETS = ((re.compile(r"[0-9]+"), math.log2(10)), (re.compile(r"[0-9a-f]+|[0-9A-F]+"), 4.0), (re.compile(r"[0-9a-z]+|[0-9A-Z]+"), math.log2(36)), (re.compile(r"[0-9A-Za-z]+"), math.log2(62)), (re.compile(r".+"), 6.0))
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern spans (kind, start, end), leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower() if text.isascii() else text.encode("ascii", "replace").decode().lower()
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


class Novelty:
    """Marginal compressed bytes of a candidate after identifiers and its surroundings."""

    def __init__(self, identifiers=IDENTIFIERS, level: int = LEVEL):
        self.prior = " ".join(identifiers).encode()
        self.params = zstandard.ZstdCompressionParameters.from_level(level, min_match=3, write_checksum=0, write_content_size=0, write_dict_id=0)

        # an empty frame has a header and one empty block, as long as a stored block's header
        self.empty = len(zstandard.ZstdCompressor(compression_params=self.params).compress(b""))

    def ratio(self, text: str, start: int, end: int) -> float:
        """Marginal bytes over those of a random string of this length and alphabet."""
        around = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]
        primed = zstandard.ZstdCompressionDict(self.prior + b" " + around.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(dict_data=primed, compression_params=self.params)
        what = text[start:end]
        bits = next(b for p, b in _ALPHABETS if p.fullmatch(what))
        # short strings are stored as they are; entropy coding pays for its table only beyond a few dozen characters
        floor = min(len(what), len(what) * bits / 8 + CODE_TABLE)
        return (len(packer.compress(what.encode("utf-8", "replace"))) - self.empty) / floor


def novel_spans(text: str, base: list[tuple[str, int, int]], novelty: Novelty) -> list[tuple[str, int, int]]:
    """Incompressible tokens in a sensitive context that no base span touches."""
    out = []
    cues = [m.start() for m in _SENSITIVE.finditer(text)]
    if not cues:
        return out
    # base spans joined where they overlap, so that one search tells whether a token touches any
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted((s, e) for _, s, e in base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    near = 0
    for m in _TOKEN.finditer(text):
        s, e = m.span()
        while near < len(cues) and cues[near] < s - NEAR_CHARS:
            near += 1
        if near == len(cues):
            break
        if cues[near] >= e or not _ALPHA.search(m[0]) or not (_DIGIT.search(m[0]) or 3 * len(_TURN.findall(m[0])) >= len(m[0])):
            continue
        k = bisect_right(ends, s)
        if k < len(starts) and starts[k] < e:
            continue
        if novelty.ratio(text, s, e) >= MIN_NOVELTY:
            out.append(("novel", s, e))
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for each row of ``docs(doc_id, text)``.

    Offsets are code points of the whole text, ends exclusive, ordered by start
    and then kind; a null or empty text has none.  Repeated rows stay rows;
    further columns are ignored.
    """

    def run(batches):
        novelty = Novelty()
        rank = {k: i for i, k in enumerate(KINDS)}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                found = base + novel_spans(text, base, novelty)
                rows.append([{"kind": k, "start": s, "end": e} for k, s, e in sorted(found, key=lambda x: (x[1], rank[x[0]]))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts per base kind, a digest of the base spans and all spans as ``kind:start:end`` lists."""
    found = find_secrets(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = text(F.filter("spans", lambda s: s["kind"] != "novel"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count("novel"))
