"""Whole documents packed into as few token sequences as possible, by repeats of few-document length patterns."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch
from ledgerlens.llm.packing import END_ID, partitioned_texts, place_pieces

WINDOW = 4096
#: Characters that some libraries hold for white space and others do not; str.split() is used only on texts without them.
UNUSUAL_SPACE = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CHUNK = re.compile(r"[^ \t\n\r]+")
#: Fixed value: the pattern by which such a vocabulary finds its words in lower-cased text, and the same over the characters of Latin-1.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS, DIGITS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\t\n\x0b\x0c\r \x85\xa0{LETTERS}{DIGITS}]+")
#: Characters of the words that a task remembers at most; beyond it begins anew.
REMEMBERED = 6 << 20


def word_encoder(vocabulary: str) -> Callable[[list[str]], list[bytes]]:
    """texts -> the ids of each (little-endian unsigned 32-bit) by the tokenizers library, for vocabularies that drop white space and never join across it.

    Such a vocabulary splits each text first, so the ids of a text are those of its parts, one after the other. Each part is encoded once and remembered (the library itself
    encodes every word of a text anew, at a fifth of this speed). In texts of Latin-1 the parts are the words, lower-cased; in others, and where added tokens
    may stand, what stands between white space. A vocabulary of other rules than these has all its texts taken in the second way.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import public_tokenizers
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as file:
        rules = json.load(file)
    whole = Tokenizer.from_str(json.dumps(rules))
    steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    latin = steps[0].get("pattern") == {"Regex": WORDS} and steps[0].get("invert") and [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    # words of Latin-1, lower-cased, are as the normalizer and the pattern leave them
    word = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps[1:]}})) if latin else whole
    # words and chunks apart: a lower-cased chunk is no word
    words: dict[str, bytes] = {}
    chunks: dict[str, bytes] = {}
    held = 0

    def is_latin(text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return latin and "<|" not in text

    def learn(new: list[str], known: dict[str, bytes], tokenizer: Tokenizer) -> None:
        nonlocal held
        for part, found in zip(new, tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[part] = array("I", found.ids).tobytes()
            held += len(part)

    def encode(texts: list[str]) -> list[bytes]:
        nonlocal held
        if held > REMEMBERED:
            words.clear()
            chunks.clear()
            held = 0
        parts = [(LATIN_WORDS.findall(t.lower()), True) if is_latin(t) else (CHUNK.findall(t) if UNUSUAL_SPACE.search(t) else t.split(), False) for t in texts]
        for known, tokenizer, kind in ((words, word, True), (chunks, whole, False)):
            learn([p for p in set(chain.from_iterable(of for of, simple in parts if simple == kind)) if p not in known], known, tokenizer)
        return [b"".join(map((words if simple else chunks).__getitem__, of)) for of, simple in parts]

    return encode


def _shared_encoder(vocabulary: str) -> Callable[[list[str]], list[bytes]]:
    """This process's encoder: a worker that runs several tasks remembers parts across them. It hangs on a library, since this module need not be there on executors."""
    import public_tokenizers

    held = vars(public_tokenizers).setdefault("_encoders_in_use", {})
    if vocabulary not in held:
        held[vocabulary] = word_encoder(vocabulary)
    return held[vocabulary]


#: Characters of the texts that are encoded together, but for one longer text.
TOGETHER = 1 << 20


def _pieces(vocabulary: str, window: int):
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _shared_encoder(vocabulary)
        seen = [0] * (window + 1)
        for batch in batches:
            texts, sizes = batch["text"].tolist(), batch["text"].str.len().cumsum()
            # rows dealt into groups of some TOGETHER characters
            for _, rows in batch.groupby(sizes // TOGETHER, sort=False).indices.items():
                out = []
                for row, ids in zip(rows, encode([texts[i] for i in rows]), strict=True):
                    key, part, ids = batch["doc_id"].iat[row], batch["part"].iat[row], ids + end
                    for piece, at in enumerate(range(0, len(ids), 4 * window)):
                        held = ids[at : at + 4 * window]
                        length = len(held) // 4
                        out.append((key, piece, at // 4, length, zlib.crc32(held), part, seen[length]))
                        seen[length] += 1
                yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"])

    return run


def pattern_pack(documents: DataFrame, window: int = WINDOW, vocabulary: str = "word_bpe_49k", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document of at most `window` ids (with its closing id) is one piece and never cut; a longer one is cut at multiples of the window. The histogram of
    piece lengths (at most `window` numbers, whatever the input) goes to the driver. There, patterns of up to three documents that fill a sequence are
    repeated as often as non-negative least squares against the histogram says, rounded down; the residual is packed best fit: the longest piece
    first, then ever the longest that still fits, by lengths and counts, not by pieces. Pieces find their place by their number among those of their length.

    Cases: a null text is an empty one (the closing id alone); a very long one fills sequences of its own but for its last piece; a null identifier stays
    null; repeated rows are documents of their own; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession)
    kind = dict(documents.dtypes)[id_col]
    pieces = partitioned_texts(documents, id_col, text_col).mapInPandas(_pieces(vocabulary, window), "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint, part int, local bigint")
    return place_pieces(scratch, scratch.table(pieces.withColumn("doc_id", F.col("doc_id").cast(kind))), window)
