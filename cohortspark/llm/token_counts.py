"""Token counts by a transducer that is reset at boundaries, and a prefix scan of chunks.

A word-level BPE tokenizer starts afresh at every boundary: white space, and inside
strings without any the places where one token must end and the next begin
whatever stands further away (next to a digit; between letters and marks, but for
the apostrophe, which may begin a contraction; never where a special string could
be under way). Between two boundaries the state is the string read since the last
one, and passing a boundary emits that string's tokens: special strings count one
each, the rest is normalised (NFC, lower case), cut by the tokenizer's pattern and
merged by its ranks. Strings are compiled when they are first met and kept while a
task runs.

Texts are cut into chunks of ``CHUNK`` characters anywhere. A chunk maps the
state in which it is entered to the state in which it is left and the tokens
emitted on the way. Because of the resets such a map is three values: the text
before its first boundary, the tokens emitted between the first and the last, and
the text after the last; a chunk without a boundary is one text. Maps
compose (the text after one and the text before the next meet, and are counted
together), composition is associative, and a document's chunks are composed in a
balanced scan. So a very long text is spread over tasks, and its count is that
of the whole text, not of its chunks.

Only chunk maps are shuffled, not texts; their ends are short unless a text has
thousands of letters or marks without a boundary (a million times one letter: such
runs are shuffled and counted whole).

Defined results: null text counts as empty, with 0 tokens; repeated rows and
null doc_ids are counted each; an empty table gives an empty result; other
columns are ignored. Only tokenizers of the described kind are supported (BPE
with byte-level words and word ends, no dropout, prefix or unknown token); others
raise ValueError.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, whole_text

CHUNK = 65_536
LIMIT = 2048
#: Compiled strings kept per task.
KEPT = 1_000_000
_SPACES = "\t-\r \x85\xa0  -     　"
_SPACE = re.compile(f"[{_SPACES}]")
_SPLIT = re.compile(f"[{_SPACES}]+")
#: Ends of chunks longer than this are cut at a boundary inside them.
ENDS = 64
#: Boundaries between two tokens that both sides see without more context: next to a
#: digit; a letter before a mark; a mark other than the apostrophe (which may begin a
#: contraction) before a letter. Only characters that normalisation leaves apart
#: from the one before, and no "<" as near as a special string is long.
_LETTER = "A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fef\uac00-\ud7a3"
_MARK = "!-&(-/:-@\\[-`{-~\u3001-\u3003\u3008-\u3011\uff01-\uff0f\uff1a-\uff20"
_BOUNDARY = regex.compile(
    rf"(?<=[0-9])(?=[0-9'{_LETTER}{_MARK}])|(?<=['{_LETTER}{_MARK}])(?=[0-9])|(?<=[{_LETTER}])(?=['{_MARK}])|(?<=[{_MARK}])(?=[{_LETTER}])"
)
#: White space for str.split only.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies use for each byte: itself where it
    is printable, else the next free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(free))
        free += b not in plain
    return out


class Transducer(dict):
    """String between white spaces -> number of tokens emitted after it."""

    def __init__(self, spec: dict):
        super().__init__()
        model = spec["model"]
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        cut, level = ((spec.get("pre_tokenizer") or {}).get("pretokenizers", []) + [{}, {}])[:2]
        kinds = [s["type"] for s in steps]
        fits = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
        fits = fits and kinds == ["NFC", "Replace", "Lowercase"] and cut.get("type") == "Split" and cut["behavior"] == "Removed" and cut["invert"]
        if not fits or level.get("type") != "ByteLevel" or level["add_prefix_space"] or level["use_regex"]:
            raise ValueError("not a tokenizer of the supported kind")
        self.pattern = regex.compile(cut["pattern"]["Regex"])
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = [vocabulary[c] for c in letters]
        self.final = [vocabulary[c + end] for c in letters]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((vocabulary[a], vocabulary[b]), (rank, vocabulary[a + b]))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        if any(not t.startswith("<") for t in special):
            raise ValueError("special strings that begin otherwise than with <")
        self.reach = max(map(len, special), default=1) - 1
        self.words: dict[str, int] = {}

    def __missing__(self, text: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        n = self[text] = self.count(text)
        return n

    def count(self, text: str) -> int:
        """Tokens of a string without white space."""
        if self.special and "<" in text:
            plain = self.special.split(text)
            return len(plain) - 1 + sum(self.plain_count(p) for p in plain if p)
        return self.plain_count(text)

    def plain_count(self, text: str) -> int:
        if not text.isascii():
            # each character on its own: no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        total = 0
        for word in self.pattern.findall(text.lower()):
            n = self.words.get(word)
            if n is None:
                if len(self.words) >= KEPT:
                    self.words.clear()
                n = self.words[word] = self.merged(word.encode("utf-8", "replace"))
            total += n
        return total

    def merged(self, word: bytes) -> int:
        """Symbols left after all merges, lowest rank first, of equals the leftmost."""
        ids = [self.inner[b] for b in word[:-1]] + [self.final[word[-1]]]
        if len(ids) > 64:
            return self.merged_long(ids)
        get = self.ranks.get
        while len(ids) > 1:
            found = [f for f in map(get, zip(ids, ids[1:])) if f]
            if not found:
                break
            _, new = best = min(found)
            i = 0
            while i < len(ids) - 1:
                if get((ids[i], ids[i + 1])) == best:
                    ids[i : i + 2] = [new]
                i += 1
        return len(ids)

    def merged_long(self, ids: list[int]) -> int:
        """The same by a heap, for long words."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (f := self.ranks.get((ids[i], ids[after[i]]))):
                heapq.heappush(heap, (f[0], i, f[1], ids[i], ids[after[i]]))

        for i in range(n):
            offer(i)
        left = n
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            left -= 1
            offer(before[i])
            offer(i)
        return left

    # -- maps of chunks: (closed, head, tokens, tail); not closed: all in head

    def cut(self, text: str, start: int, stop: int, last: bool = False) -> int | None:
        """The first (or last) boundary of text at start or later, up to stop."""
        found = None
        for m in _BOUNDARY.finditer(text, start, stop + 1):
            at = m.start()
            if at >= self.reach and "<" not in text[at - self.reach : at]:
                found = at
                if not last:
                    break
        return found

    def chunk_map(self, text: str) -> tuple[bool, str, int, str]:
        space = _SPACE.search(text)
        first = space.start() if space else len(text)
        if first > ENDS and (at := self.cut(text, ENDS, first)) is not None:
            first = at
        elif space is None:
            return False, text, 0, ""
        head, text = text[:first], text[first:]
        units = _SPLIT.split(text) if _SEPARATORS.search(text) else text.split()
        # split drops or keeps empty ends; the end of the text is the tail
        tail = "" if not text or _SPACE.match(text[-1]) else units.pop()
        if len(tail) > ENDS and (at := self.cut(tail, 0, len(tail) - ENDS // 2, True)) is not None:
            units.append(tail[:at])
            tail = tail[at:]
        return True, head, sum(map(self.__getitem__, filter(None, units))), tail

    def compose(self, a: tuple[bool, str, int, str], b: tuple[bool, str, int, str]) -> tuple[bool, str, int, str]:
        if not a[0]:
            return b[0], a[1] + b[1], b[2], b[3]
        if not b[0]:
            return True, a[1], a[2], a[3] + b[1]
        return True, a[1], a[2] + self.string(a[3] + b[1]) + b[2], b[3]

    def string(self, text: str) -> int:
        return self[text] if text else 0

    def total(self, maps: list[tuple[bool, str, int, str]]) -> int:
        """Tokens of a text from the maps of its chunks, composed in a balanced tree."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return sum(self.string(t) for t in (maps[0][1], maps[0][3])) + maps[0][2] if maps else 0


@lru_cache(maxsize=2)
def compiled(path: str) -> Transducer:
    with open(path, encoding="utf-8") as f:
        return Transducer(json.load(f))


def token_counts(docs: DataFrame, tokenizer: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): one row per document; tokenizer: path of the
    tokenizer's file on every machine."""
    text = whole_text()
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(chunk)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    parts = rows.select("row", "doc_id", starts.alias("at"), "text").select("row", "doc_id", "at", F.substring("text", F.col("at") + 1, chunk).alias("text"))

    def maps(batches):
        run = compiled(tokenizer)
        for b in batches:
            texts = b.column(3).to_pylist()
            found = list(zip(*map(run.chunk_map, texts))) or [(), (), (), ()]
            kinds = [pa.bool_(), pa.string(), pa.int64(), pa.string()]
            columns = [b.column(0), b.column(1), b.column(2), pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()), *[pa.array(f, k) for f, k in zip(found, kinds)]]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "at", "bytes", "closed", "head", "n", "tail"])

    mapped = parts.mapInArrow(maps, "row long, doc_id long, at int, bytes long, closed boolean, head string, n long, tail string")
    whole = mapped.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sum("bytes").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("at", "closed", "head", "n", "tail"))).alias("maps")
    )

    def scan(batches):
        run = compiled(tokenizer)
        for b in batches:
            counts = [run.total([(m["closed"], m["head"], m["n"], m["tail"]) for m in ms]) for ms in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return whole.select("doc_id", "n_bytes", "maps").mapInArrow(scan, "doc_id long, n_bytes long, n_tokens long")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
