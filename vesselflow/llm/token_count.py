"""Token counts with a whole-token shortcut.

The vocabulary (BPE over words, white space dropped) is proved once on the driver: a string of the vocabulary that ends a word is
*whole* if merging its bytes by the model's rules gives that one token.  A pre-token's tokens depend on the pre-token alone, so
every later pre-token that is whole counts one without any merge.  The whole strings (at most the vocabulary) are broadcast; in
the tasks only pre-tokens that are not whole are merged, by the tokenizer's own model.

White space always ends a pre-token here, so texts are counted word by word: a word's count is the sum over its pre-tokens, and
words seen before are looked up in a bounded memo.  The proof covers letters too: a letter of ``LETTERS`` is *plain* if the
library maps it to one letter that joins its neighbours' pre-token, and its bytes are noted.  Pre-tokens of words of plain letters and
printable ASCII come from the pattern in ``_PLAIN``; other words go through the tokenizer's own normaliser and pre-tokeniser, and words with
a special string through the whole tokenizer.  ``prove`` refuses a tokenizer for which this reasoning does not hold.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows that repeat are counted each; a null id is kept;
an empty table gives an empty result; other columns are not read.  Texts over ``CHUNK`` characters are cut at white
space and their pieces' counts added, so no list grows with the longest text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselflow.llm.common import CHUNK, workers

END = "</w>"
LIMIT = 2048
# Words that a task remembers, and the longest of them.
MEMO_WORDS, MEMO_LENGTH = 400_000, 64
# Code points whose letters are tried: Latin without combining marks, and Cyrillic.
LETTERS = [*range(0xC0, 0x250), *range(0x400, 0x460)]
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_WHITE = re.compile(r"[\x20\x09-\x0D]")
_PRINTABLE = re.compile(r"[\x21-\x7E]+")
# The tokenizer's split pattern, and the same for lower-cased printable ASCII and the bytes of plain letters.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\uFFFF]+|[0-9]|[^a-z0-9\x80-\uFFFF]+")


def vocabulary_path(vocabulary: str) -> str:
    """A file's path as it is, or the place of a public tokenizer's file of that name."""
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers
    return public_tokenizers.path(vocabulary)


def _load(vocabulary: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary_path(vocabulary))


class Proof(NamedTuple):
    """What holds for a vocabulary: pre-tokens that are one token, the bytes of plain characters, special strings."""
    whole: frozenset[str]
    plain: dict[int, str]
    special: tuple[str, ...]


def prove(vocabulary: str) -> Proof:
    """Merge every candidate of the vocabulary, and try every letter of ``LETTERS``."""
    with open(vocabulary_path(vocabulary), encoding="utf-8") as f:
        spec = json.load(f)
    model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first, kinds = steps[0], [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers") or []]
    if (model.get("type") != "BPE" or model.get("end_of_word_suffix") != END or model.get("dropout") or spec.get("post_processor")
            or first.get("pattern", {}).get("Regex") != _SPLIT or (first.get("behavior"), first.get("invert")) != ("Removed", True)
            or kinds != ["NFC", "Replace", "Lowercase"] or [s.get("type") for s in steps[1:]] != ["ByteLevel"]):
        raise ValueError("the whole-token shortcut holds for word-end BPE over pre-tokens without white space only")
    special = tuple(t["content"] for t in spec.get("added_tokens") or [])
    if not all(_PRINTABLE.fullmatch(s) for s in special):
        raise ValueError("a special string with white space or other characters")
    lib = _load(vocabulary)

    def parts(text: str) -> list[str]:
        return [p for p, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))]

    plain = {ord(c): c.lower() for c in map(chr, range(0x21, 0x7F))}
    for c in map(chr, LETTERS):
        bytes_of = parts(c)
        if len(bytes_of) == 1 and len(lib.normalizer.normalize_str(c)) == 1 and parts(f"a{c}a") == [f"a{bytes_of[0]}a"] and not bytes_of[0].isascii():
            plain[ord(c)] = bytes_of[0]
    ends = (v.removesuffix(END) for v in model["vocab"] if v.endswith(END))
    return Proof(frozenset(p for p in ends if p and len(lib.model.tokenize(p)) == 1), plain, special)


class Counter(dict):
    """Tokens of a word; missing words are counted and remembered."""

    def __init__(self, vocabulary: str, proof: Proof):
        super().__init__()
        self.lib, self.whole, self.bytes_of = _load(vocabulary), proof.whole, proof.plain
        self.merge, self.merged = self.lib.model.tokenize, 0
        self.special = re.compile("|".join(map(re.escape, proof.special)) or r"(?!)")
        self.simple = re.compile("[" + "".join(re.escape(chr(c)) for c in proof.plain) + "]+")

    def _tokens(self, pre: str) -> int:
        if pre in self.whole:
            return 1
        self.merged += 1
        return len(self.merge(pre))

    def __missing__(self, word: str) -> int:
        if self.special.search(word):
            return len(self.lib.encode(word, add_special_tokens=False).ids)
        if self.simple.fullmatch(word):
            n = sum(map(self._tokens, _PLAIN.findall(word.translate(self.bytes_of))))
        else:
            normal = self.lib.normalizer.normalize_str(word)
            n = sum(self._tokens(pre) for pre, _ in self.lib.pre_tokenizer.pre_tokenize_str(normal))
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = n
        return n

    def text(self, text: str) -> int:
        return sum(sum(map(self.__getitem__, _WORD.findall(p))) for p in pieces(text))


def pieces(text: str, size: int = CHUNK) -> Iterator[str]:
    """Cuts of a long text at white space, each about ``size`` characters."""
    at = 0
    while len(text) - at > size:
        cut = _WHITE.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    spark = docs.sparkSession
    workers(spark)
    proved = spark.sparkContext.broadcast(prove(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocabulary, proved.value)
        for b in batches:
            n = [count.text(t) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                                  names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long"), F.octet_length(text).cast("long"), text).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
