"""Language identification by compression.

For every language a zstandard raw-content dictionary is made of labelled texts.
A text is brought to lower case, with one space for all that is no letter, and
compressed with each dictionary, in blocks of BLOCK_BYTES so that a long text keeps
asking the dictionaries and not itself; the language with the smallest total wins. The margin is the share by which the runner-up is larger;
where it is below MARGIN the decision is rejected. The score rises with the margin
from 0.5 (no difference) to 1.

Dictionaries are fitted on a bounded sample: per language at most SAMPLE_TEXTS
texts of MIN_BYTES to MAX_BYTES bytes, those with the lowest hash of the id, of
which DICTIONARY_BYTES are kept. Prediction reads whole texts of all rows, and
nothing but the text.

Null texts and texts without a letter are `und`, with score 0, and rejected.
Without any labelled row everything is `und`. Languages with equal sizes go by
name. Equal texts get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import annotated

SAMPLE_TEXTS = 240
MIN_BYTES, MAX_BYTES = 200, 20_000
DICTIONARY_BYTES = 64_000
#: Labels that get a dictionary, those with the most rows first.
MAX_LANGUAGES = 200
BLOCK_BYTES = 4_096
#: Texts up to this size are also compressed from three later starts: a few bytes are too coarse a measure.
SHORT_BYTES = 1_024
MARGIN = 0.001
UNKNOWN = "und"

_PLAIN = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
_LETTER = regex.compile(r"\p{L}")


def dictionaries(train: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 lang_col: str = "lang") -> dict[str, bytes]:
    """The dictionary content of each language, from a bounded sample of the given rows."""
    rows = train.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"),
                        F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.octet_length("text").between(MIN_BYTES, MAX_BYTES))
    order = F.xxhash64("id")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    # Every language's lowest hashes: a threshold that leaves about twice the wanted rows, cut to the bound after.
    keep = F.lit(False)
    for lang, count in counts:
        share = min(1.0, 2 * SAMPLE_TEXTS / count)
        bound = int(-(1 << 63) + share * ((1 << 64) - 1))
        keep = keep | ((F.col("lang") == lang) & (order <= F.lit(max(min(bound, (1 << 63) - 1), -(1 << 63)))))
    chosen: dict[str, list] = {}
    for row in rows.filter(keep).select("lang", "text", order.alias("at")).collect() if counts else []:
        chosen.setdefault(row.lang, []).append((row.at, row.text))
    out = {}
    for lang, texts in sorted(chosen.items()):
        some = [normalized(text) for _, text in sorted(set(texts))[:SAMPLE_TEXTS]]
        room = max(1, DICTIONARY_BYTES // len(some))  # an excerpt of each, from anywhere in it
        content = b"\n".join(t[(at := crc32(t) % max(1, len(t) - room)): at + room] for t in some)
        out[lang] = content
    return out


FIELDS = "lang_pred string, score double, margin double, rejected boolean"


def identified(docs: DataFrame, learned: dict[str, bytes], *, margin: float = MARGIN, text_col: str = "text",
               name: str = "language") -> DataFrame:
    """All rows and columns, and a struct `name` of lang_pred, score, margin and rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(learned)

    def work(texts: pa.Array) -> dict:
        compressors = _Compressors.of(sent.value)
        lang, score, gap = zip(*(_decide(compressors, text) for text in texts.to_pylist()), strict=True)
        return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()),
                "margin": pa.array(gap, pa.float64()),
                "rejected": pa.array([x == UNKNOWN or g < margin for x, g in zip(lang, gap, strict=True)], pa.bool_())}

    return annotated(docs, text_col, work, FIELDS, name)


class _Compressors:
    """One compressor for each language; a Python worker makes them once."""

    _kept: tuple[int, list] = (0, [])

    @classmethod
    def of(cls, learned: dict[str, bytes]) -> list:
        if cls._kept[0] != id(learned):
            made = []
            for lang, content in sorted(learned.items()):
                own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                settings = zstandard.ZstdCompressionParameters(
                    strategy=zstandard.STRATEGY_LAZY2, window_log=17, hash_log=16, chain_log=16, search_log=5, min_match=3,
                    write_checksum=False, write_content_size=False, write_dict_id=False)
                own.precompute_compress(compression_params=settings)
                made.append((lang, zstandard.ZstdCompressor(dict_data=own, compression_params=settings)))
            cls._kept = (id(learned), made)
        return cls._kept[1]


def normalized(text: str) -> bytes:
    """Lower case, and one space for everything of ASCII that is no letter."""
    return b" ".join(text.lower().encode("utf-8").translate(_PLAIN).split())


def _decide(compressors: list, text: str | None) -> tuple[str, float, float]:
    if not text or not compressors or not _LETTER.search(text):
        return UNKNOWN, 0.0, 0.0
    raw = normalized(text)
    if len(raw) <= SHORT_BYTES:
        blocks = [raw[len(raw) * i // 4:] for i in range(4)]
    else:
        blocks = [raw[i: i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in compressors)
    if len(sizes) == 1:
        return sizes[0][1], 1.0, 1.0
    gap = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][1], float(0.5 + 0.5 * np.tanh(12 * gap)), gap
