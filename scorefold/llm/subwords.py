"""Subword ids of whole texts by the tokenizers library, with caches of words and pieces inside each Python worker.

A tokenizer file of the usual layout (NFC, white space to blanks, lower case; letter runs, single digits and symbol runs;
byte-level BPE with word ends) never joins two words parted by white space. Its texts are therefore encoded word by word,
and a word met before costs one lookup. Words of characters other than ASCII and Latin-1 letters, texts that hold a special
token's string and files of any other layout go through Tokenizer.encode as they are.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorefold.llm import common

#: Letters whose lower case and normal form need no look at their neighbours.
SAFE = re.compile(r"[\n\t\r !-~À-ÿ]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: The layout that the word-by-word way is right for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def printable_bytes() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


def word_by_word(config: dict) -> bool:
    norm, pre = config.get("normalizer") or {}, config.get("pre_tokenizer") or {}
    steps = [(x["type"], x.get("pattern"), x.get("content")) for x in norm.get("normalizers", [])]
    cuts = pre.get("pretokenizers", [])
    return (
        steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        and len(cuts) == 2
        and cuts[0].get("pattern") == {"Regex": SPLIT}
        and (cuts[0].get("behavior"), cuts[0].get("invert")) == ("Removed", True)
        and (cuts[1]["type"], cuts[1].get("add_prefix_space"), cuts[1].get("use_regex")) == ("ByteLevel", False, False)
        and config["model"]["type"] == "BPE"
    )


class Recent(dict):
    """A cache that forgets by generations: when it is full it starts anew, and what is asked for again comes over."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.work_out(key)
        self[key] = found
        return found


class Pieces(Recent):
    """Lower-case words of the characters of SAFE, and the pieces that they are cut into, in one cache: most words are one piece."""

    def __init__(self, model, most: int):
        super().__init__(most)
        self.model, self.alphabet = model, printable_bytes()

    def work_out(self, word: str) -> bytes:
        if not word.isalpha():
            if word[:-1].isalpha():  # letters and one sign
                return self[word[:-1]] + self[word[-1]]
            found = PIECE.findall(word)
            if len(found) > 1:
                return b"".join([self[p] for p in found])
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()


class Words(Recent):
    """Words parted by blanks, of any characters."""

    def __init__(self, tokenizer, pieces: Pieces, most: int):
        super().__init__(most)
        self.tokenizer, self.pieces = tokenizer, pieces

    def work_out(self, word: str) -> bytes:
        if SAFE.fullmatch(word):
            return b"".join([self.pieces[w] for w in word.lower().split()])
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()


class Subwords:
    """ids(text) gives Tokenizer.encode(text, add_special_tokens=False) as unsigned 32-bit integers.

    cached: entries of a generation of both caches (about 0.2 kB each; two generations are kept): texts of SAFE characters
    need that of words and pieces alone, which has three fifths of them.
    """

    def __init__(self, path: str, cached: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.special = [x["content"] for x in config.get("added_tokens", [])]
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.words = Words(self.tokenizer, Pieces(self.tokenizer.model, cached * 3 // 5), cached * 2 // 5) if word_by_word(config) else None

    def forget(self) -> None:
        """Empty the caches: at the end of a task, so that a worker which waits for other work holds no words."""
        for cache in (self.words, self.words.pieces) if self.words is not None else ():
            cache.clear()
            cache.old = {}

    def ids(self, text: str | None) -> bytes:
        """Little-endian ids of the whole text; a null text counts as empty."""
        if not text:
            return b""
        if self.words is None or any(x in text for x in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if SAFE.fullmatch(text):
            return b"".join(map(self.words.pieces.__getitem__, text.lower().split()))
        return b"".join(map(self.words.__getitem__, text.split(" ")))


@lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    """One instance for each file and worker process; it lives as long as the worker, its caches as long as a task."""
    return Subwords(path)


def encode(docs: DataFrame, path: str, end_id: int, text: str = "text", flush_bytes: int = 8 << 20) -> DataFrame:
    """The id columns of docs beside `ids`: binary, little-endian unsigned 32-bit, with end_id appended to each text.

    Null texts count as empty. Every other column goes along; a column named `ids` is replaced. Batches leave a task when
    they hold flush_bytes, whatever a single text's length.
    """
    import pyarrow as pa

    docs = docs.drop("ids") if "ids" in docs.columns else docs
    common.text_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text]
    out = docs.select(*keep, F.lit(b"").alias("ids")).schema
    end = array("I", [end_id]).tobytes()

    def run(batches):
        coder = subwords(path)
        for batch in batches:
            texts, kept = batch.column(text), batch.select(keep)
            ids, size, begun = [], 0, 0
            for k in range(len(texts)):
                ids.append(coder.ids(texts[k].as_py()) + end)
                size += len(ids[-1])
                if size >= flush_bytes or k + 1 == len(texts):
                    part = kept.slice(begun, len(ids))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], names=[*keep, "ids"])
                    ids, size, begun = [], 0, k + 1
        coder.forget()

    return docs.select(*keep, text).mapInArrow(run, out)
