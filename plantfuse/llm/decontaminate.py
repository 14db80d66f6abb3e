"""Documents that contain benchmark items, exactly or with some words edited.

Words are runs of letters, digits and underscores in lower case; in scripts that
are written without blanks each letter, mark or digit is a word. An item of n
words is found in a document if some window of the document's words is within
floor(``max_edits`` * n) word insertions, deletions and substitutions of it.
Items of up to ``FEW_WORDS`` words that may not be edited are looked up as they
are; the others are searched in three steps.

1. CGK embedding: a pointer walks over a sequence, writing the word under it at
   every step and moving on by a random bit that depends on the step and the
   word. Two sequences a few edits apart write mostly the same words at the same
   steps, so their edit distance becomes a Hamming distance.
2. Bit-sampling LSH: windows of the size of an item are embedded at every word
   of every document, and meet the items that wrote the same words at the
   sampled steps. A window is followed from one sampled step to the next only
   while some item still agrees, which gives the same meetings as embedding it
   whole. Items of about one size share their steps, as many as the least of
   them has words. Half of the repetitions walk windows from their ends.
3. Each meeting is verified by the exact edit distance, in a band.

Walks lose each other the further they go. An item of over ``PART`` words is
therefore searched by parts of about equal size: if it is within its bound, one
of its parts at least is within its own. From a part that is found the item's
beginning follows by aligning what stands before the part backwards, and the
whole item is verified from there.

``REPEATS`` samples in each direction were chosen so that items with 20 % of
their words edited are found with a recall over 0.9, those with 10 % over 0.98
(measured in the tests, up to 1,000 words); an unedited item agrees with itself
in every sample.

Items reach the tasks in blocks of bounded size, and documents are only mapped:
nothing is shuffled, so no key can be hot. NULL and empty texts contain nothing,
and items without a word, NULL ones among them, are in no document. Each row of
either table is one document or item; other columns play no part.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plantfuse.llm.shared import slices

MIN_WORDS = 1
#: Words up to which items without an allowed edit are looked up.
FEW_WORDS = 4
#: Sampled steps that must agree, walks in each direction, samples of each walk.
STEPS, WALKS, REPEATS = 3, 2, 3
SEED = 20_260_101
#: Words of an item, or of each of its parts, that is searched as one.
PART = 31
#: Bits of an item's set of words, which only spares hopeless verifications.
SET_BITS = 256
#: Words of documents that are walked at once.
CHUNK = 1 << 15
#: Words of documents whose meetings are verified together.
GROUP = 1 << 18
#: Words of windows that are verified at once.
CELLS = 1 << 20
#: Bytes of items that go to a task at once.
BLOCK_BYTES = 4 << 20

# Blocks of scripts that are written without blanks between words.
UNSPACED = (
    "0e00-0eff 0f00-0fff 1000-109f 1780-17ff 1950-19df 1a20-1aaf 1b00-1b7f 3005-3007 3021-3029 "
    "3031-3035 303b-303c 3041-3096 3099-309a 309d-309f 30a1-30fa 30fc-312f 31a0-31ff 3400-4dbf "
    "4e00-a4cf a980-a9ff aa60-aadf f900-faff ff66-ff9f 1aff0-1b16f 20000-323af"
)


def _unspaced() -> str:
    """The letters, marks and digits of these blocks, as ranges of a character class."""
    ranges: list[list[int]] = []
    for block in UNSPACED.split():
        first, last = (int(end, 16) for end in block.split("-"))
        for code in range(first, last + 1):
            if unicodedata.category(chr(code))[0] in "LMN":
                if ranges and ranges[-1][1] == code - 1:
                    ranges[-1][1] = code
                else:
                    ranges.append([code, code])
    return "".join(f"{chr(first)}-{chr(last)}" for first, last in ranges)


WORD = re.compile(rf"[{_unspaced()}]|[^\W{_unspaced()}]+")
SPACED_WORD = re.compile(r"\w+")


def _word(text: str) -> re.Pattern[str]:
    return SPACED_WORD if text.isascii() else WORD


def words_of(text: str) -> list[str]:
    return _word(text).findall(text)


def places_of(text: str) -> Iterator[re.Match[str]]:
    return _word(text).finditer(text)


def edits_allowed(n_words: int, max_edits: float) -> int:
    return int(n_words * max_edits + 1e-9)


class Walk:
    """One random walk over items of about one size, and the samples taken of it."""

    def __init__(self, items: list[tuple[int, np.ndarray]], alphabet: int, seed: Sequence[int]):
        rng = np.random.default_rng(seed)
        steps = min(len(words) for _, words in items)
        self.bits = rng.integers(0, 2, (steps, alphabet), dtype=np.intp)
        self.alphabet = alphabet
        written = np.empty((len(items), steps), np.int64)
        for row, (_, words) in enumerate(items):
            at = 0
            for step in range(steps):
                written[row, step] = words[at]
                at += self.bits[step, words[at]]
        self.samples = []
        for _ in range(REPEATS):
            sample = np.sort(rng.choice(steps, min(STEPS, steps), replace=False)).tolist()
            keys = np.zeros(len(items), np.int64)
            known = []
            for step in sample:
                keys = keys * alphabet + written[:, step]
                known.append(np.unique(keys))
            first = np.zeros(alphabet, bool)
            first[known[0]] = True
            order = np.argsort(keys, kind="stable")
            numbers = np.array([items[row][0] for row in order])
            self.samples.append((sample, first, known, keys[order], numbers))
        self.samples.sort(key=lambda sample: sample[0][0])

    def meetings(self, words: np.ndarray, windows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, window): windows, by their first word, that agree with items.

        ``words`` goes on behind the last window by the steps of the walk.
        """
        at, step = np.arange(windows), 0
        for sample, first, known, keys, numbers in self.samples:
            at = self._moved(words, at, step, sample[0])
            step = sample[0]
            word = words.take(at, mode="clip")
            window = np.flatnonzero(first[word])
            key, there, now = word[window], at[window], step
            for later, seen in zip(sample[1:], known[1:]):
                there = self._moved(words, there, now, later)
                now = later
                key = key * self.alphabet + words[there]
                found = seen[np.minimum(np.searchsorted(seen, key), len(seen) - 1)] == key
                window, key, there = window[found], key[found], there[found]
            low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
            while len(window):
                yield numbers[low], window
                low = low + 1
                more = low < high
                low, high, window = low[more], high[more], window[more]

    def _moved(self, words: np.ndarray, at: np.ndarray, step: int, later: int) -> np.ndarray:
        for moving in range(step, later):
            at = at + self.bits[moving].take(words.take(at, mode="clip"), mode="clip")
        return at


def distances(
    items: np.ndarray, sizes: np.ndarray, texts: np.ndarray, bounds: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end): the edit distance of each item to the best beginning of its text.

    Rows are padded: items by -1, texts by -2. Distances above a row's bound
    are only known to be above it. Cells further than the bound from the
    diagonal are never visited. Of equally good beginnings the shortest counts.
    """
    count, band = len(items), int(bounds.max(initial=0))
    far = np.int32(1 << 20)
    offsets = np.arange(-band, band + 1)
    # row[:, d]: distance of the item's first i words to the text's first i + d - band.
    row = np.where(offsets >= 0, offsets, far).astype(np.int32) + np.zeros((count, 1), np.int32)
    best, end = np.full(count, far), np.zeros(count, np.int64)
    padded = np.pad(texts, ((0, 0), (band, band + items.shape[1] + 1)), constant_values=-2)
    open_rows = np.arange(count)
    for i in range(int(sizes.max(initial=0)) + 1):
        done = sizes[open_rows] == i
        if done.any():
            rows = open_rows[done]
            reach = row[done]
            at = reach.argmin(1)
            best[rows], end[rows] = reach[np.arange(len(rows)), at], i + at - band
        going = ~done & (row.min(1) <= bounds[open_rows])
        if not going.all():
            open_rows, row = open_rows[going], row[going]
        if not len(open_rows):
            break
        # The text's words under the band of the item's word i.
        under = padded[open_rows, i : i + 2 * band + 1]
        new = row + (under != items[open_rows, i][:, None])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        # Each cell is at most one more than the cell before it.
        new = np.minimum.accumulate(new - offsets, axis=1) + offsets
        new[:, offsets < -(i + 1)] = far
        row = new
    return best, end


class Phrases:
    """Items of one size that are looked up as they are."""

    def __init__(self, items: list[tuple[int, np.ndarray]], alphabet: int):
        self.alphabet = alphabet
        self.known = []
        code = np.zeros(len(items), np.int64)
        for words in np.array([words for _, words in items]).T:
            known, code = np.unique(code * alphabet + words, return_inverse=True)
            self.known.append(known)
        order = np.argsort(code, kind="stable")
        self.codes, self.numbers = code[order], np.array([items[row][0] for row in order])

    def places(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, first word), in order of the words for each item."""
        at = np.arange(max(0, len(words) - len(self.known) + 1))
        code = np.zeros(len(at), np.int64)
        for step, known in enumerate(self.known):
            key = code * self.alphabet + words[at + step]
            code = np.minimum(np.searchsorted(known, key), len(known) - 1)
            found = known[code] == key
            at, code = at[found], code[found]
        low, high = np.searchsorted(self.codes, code), np.searchsorted(self.codes, code, side="right")
        while len(at):
            yield self.numbers[low], at
            low = low + 1
            more = low < high
            low, high, at = low[more], high[more], at[more]


class Finder:
    """A block of items, ready to be found in documents."""

    def __init__(self, items: Sequence[tuple[object, str | None]], max_edits: float):
        split = [(key, words_of((text or "").lower())) for key, text in items]
        split = [(key, words) for key, words in split if len(words) >= MIN_WORDS]
        self.keys = [key for key, _ in split]
        self.ids = {word: 1 for _, words in split for word in words}
        self.ids = {word: number for number, word in enumerate(self.ids, 1)}
        self.items = [np.array([self.ids[word] for word in words], np.intp) for _, words in split]
        self.sizes = np.array([len(words) for words in self.items], np.int64)
        # The parts of long items follow all items, as items of their own.
        self.whole, self.offset = list(range(len(self.items))), [0] * len(self.items)
        long = np.flatnonzero(self.sizes > PART).tolist()
        for number in long:
            at = 0
            for words in np.array_split(self.items[number], -(-int(self.sizes[number]) // PART)):
                self.items.append(words)
                self.whole.append(number)
                self.offset.append(at)
                at += len(words)
        self.whole, self.offset = np.array(self.whole, np.intp), np.array(self.offset, np.int64)
        self.sizes = np.array([len(words) for words in self.items], np.int64)
        self.bounds = np.array([edits_allowed(size, max_edits) for size in self.sizes.tolist()], np.int64)
        # Each item's set of words as bits of a few machine words.
        self.sets = np.zeros((len(self.items), SET_BITS // 64), np.uint64)
        for of, words in zip(self.sets, self.items):
            np.bitwise_or.at(of, words % SET_BITS >> 6, np.uint64(1) << (words % 64).astype(np.uint64))
        by_size: dict[int, list[int]] = {}
        few: dict[int, list[tuple[int, np.ndarray]]] = {}
        for number, size in enumerate(self.sizes.tolist()):
            if size <= FEW_WORDS and not self.bounds[number]:
                few.setdefault(size, []).append((number, self.items[number]))
            elif size <= PART:
                by_size.setdefault(size.bit_length(), []).append(number)
        self.phrases = [Phrases(items, len(self.ids) + 1) for items in few.values()]
        self.walks = [
            (
                direction,
                Walk(
                    [(number, self.items[number][::direction]) for number in numbers],
                    len(self.ids) + 1,
                    (SEED, length, walk, direction > 0),
                ),
            )
            for length, numbers in sorted(by_size.items())
            for walk in range(WALKS)
            for direction in (1, -1)
        ]

    def _batches(self, pairs: np.ndarray, item: np.ndarray) -> Iterator[np.ndarray]:
        """The pairs in order of their items' sizes, so many at once as fit ``CELLS``."""
        width = (self.sizes + 2 * self.bounds)[item]
        order = np.argsort(width, kind="stable")
        pairs, width = pairs[order], width[order]
        at = 0
        while at < len(pairs):
            size = max(1, CELLS // int(width[at]))
            size = max(1, min(size, CELLS // int(width[min(at + size, len(pairs)) - 1])))
            yield pairs[at : at + size]
            at += size

    def _verified(self, words, item, window, stop, direction):
        """The meetings within their item's bound: (item, first, end, edits) in words."""
        size, bound = self.sizes[item], self.bounds[item]
        width = int((size + bound).max())
        place = window[:, None] + np.arange(width)
        texts = np.where(place < stop[:, None], words[np.minimum(place, len(words) - 1)], -2)
        # At least the item's words that are not in the window must be edited.
        bits = self.sets[item[:, None], texts % SET_BITS >> 6]
        shared = bits >> (texts % 64).astype(np.uint64) & np.uint64(1)
        shared = (shared.astype(bool) & (texts > 0)).sum(1)
        hopeful = np.flatnonzero(shared >= size - bound)
        if not len(hopeful):
            return item[:0], window[:0], window[:0], bound[:0]
        item, window, texts = item[hopeful], window[hopeful], texts[hopeful]
        size, bound = size[hopeful], bound[hopeful]
        items = np.full((len(item), int(size.max())), -1, np.int32)
        for row, number in enumerate(item.tolist()):
            items[row, : size[row]] = self.items[number][::direction]
        edits, end = distances(items, size, texts, bound)
        good = np.flatnonzero(edits <= bound)
        return item[good], window[good], window[good] + end[good], edits[good]

    def find(self, texts: Sequence[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first, end, edits): the best window found of every item in every text.

        Of equally good windows the first, then the shortest counts.
        """
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        get = self.ids.get
        group: list[tuple[int, np.ndarray]] = []
        size = 0
        for number, text in enumerate(texts):
            words = words_of((text or "").lower())
            group.append((number, np.fromiter(map(get, words, repeat(0)), np.intp, len(words))))
            size += len(words)
            if size >= GROUP:
                self._find(group, found)
                group, size = [], 0
        self._find(group, found)
        return [(*key, first, end, edits) for key, (edits, first, end) in sorted(found.items())]

    def _find(self, group, found) -> None:
        if not self.items:
            return
        ends = np.cumsum([len(words) for _, words in group])
        if not len(ends) or not ends[-1]:
            return
        total = int(ends[-1])
        words = np.concatenate([words for _, words in group])
        owner = np.repeat(np.arange(len(group)), np.diff(ends, prepend=0))
        starts = ends - np.diff(ends, prepend=0)
        parts: set[tuple[int, int, int]] = set()

        def note(n: int, first: int, end: int, edits: int) -> None:
            at_row = int(owner[min(first, total - 1)])
            start = int(starts[at_row])
            key = (group[at_row][0], n)
            value = (edits, first - start, end - start)
            if key not in found or value < found[key]:
                found[key] = value

        for phrases in self.phrases:
            last = len(phrases.known) - 1
            for item, first in phrases.places(words):
                inside = owner[first] == owner[first + last]
                item, first = item[inside], first[inside]
                # The first place of each item in each document.
                _, once = np.unique(item * len(group) + owner[first], return_index=True)
                for n, at in zip(item[once].tolist(), first[once].tolist()):
                    note(n, at, at + last + 1, 0)
        # Backwards, positions count from the last word of the group.
        for direction in (1, -1):
            line = words[::direction]
            stops = ends[owner] if direction > 0 else (total - starts[owner])[::-1]
            met = [
                pair
                for way, walk in self.walks
                if way == direction
                for pair in self._met(walk, line)
            ]
            if not met:
                continue
            pairs = np.unique(np.concatenate(met))
            for part in self._batches(pairs, pairs // total):
                item, window = part // total, part % total
                for n, first, end, edits in zip(
                    *(x.tolist() for x in self._verified(line, item, window, stops[window], direction))
                ):
                    if direction < 0:
                        first, end = total - end, total - first
                    if n < len(self.keys):
                        note(n, first, end, edits)
                    elif first < end:
                        parts.add((n, first, edits))
        if parts:
            self._find_whole(words, owner, starts, ends, parts, note)

    def _find_whole(self, words, owner, starts, ends, parts, note) -> None:
        """Long items around parts that were found.

        Parts on about one diagonal are of one window. They are tried in turn,
        those with fewest edits first, until the item is found there.
        """
        places: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}
        for part, first, edits in parts:
            item = int(self.whole[part])
            place = (first - int(self.offset[part])) // (int(self.bounds[item]) + 1)
            at = places.setdefault((int(owner[first]), item, place), [])
            at.append((edits, int(self.offset[part]), first))
        for at in places.values():
            at.sort(reverse=True)
        while places:
            tried = [(key, *at.pop()[1:]) for key, at in places.items()]
            tried.sort(key=lambda row: self.sizes[row[0][1]])
            at = 0
            while at < len(tried):
                item = np.array([key[1] for key, _, _ in tried[at : at + GROUP]])
                width = (self.sizes + 2 * self.bounds)[item]
                fits = max(1, int((np.arange(1, len(width) + 1) * width <= CELLS).sum()))
                some = tried[at : at + fits]
                at += fits
                item = item[:fits]
                offset, place = (np.array([row[n] for row in some], np.int64) for n in (1, 2))
                row = owner[place]
                # Backwards from the part to the item's beginning, then the whole item.
                edits, back = self._aligned(words, item, offset, place - 1, starts[row], -1)
                good = np.flatnonzero(edits <= self.bounds[item])
                item, first, row = item[good], (place - back)[good], row[good]
                edits, size = self._aligned(words, item, self.sizes[item], first, ends[row] - 1, 1)
                for n, number in enumerate(good.tolist()):
                    if edits[n] <= self.bounds[item[n]]:
                        note(int(item[n]), int(first[n]), int(first[n] + size[n]), int(edits[n]))
                        places[some[number][0]] = []
            places = {key: at for key, at in places.items() if at}

    def _aligned(self, words, item, sizes, at, last, step):
        """(edits, words taken) of the items' first words against the text from ``at`` on.

        With a step of -1 both are read backwards: the items from their word
        before ``sizes``, the text from ``at`` down to ``last``.
        """
        if not len(item):
            return sizes, sizes
        bound = self.bounds[item]
        place = at[:, None] + step * np.arange(int((sizes + bound).max()))
        inside = (last[:, None] - place) * step >= 0
        texts = np.where(inside, words[np.clip(place, 0, len(words) - 1)], -2)
        items = np.full((len(item), int(sizes.max())), -1, np.int64)
        for row, (number, size) in enumerate(zip(item.tolist(), sizes.tolist())):
            items[row, :size] = self.items[number][:size][::step]
        return distances(items, sizes, texts, bound)

    def _met(self, walk: Walk, line: np.ndarray) -> Iterator[np.ndarray]:
        total = len(line)
        for at in range(0, total, CHUNK):
            windows = min(CHUNK, total - at)
            piece = line[at : at + windows + len(walk.bits)]
            piece = np.pad(piece, (0, windows + len(walk.bits) - len(piece)))
            for item, window in walk.meetings(piece, windows):
                yield item * total + window + at


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    max_edits: float = 0.2,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """A row for each item that a document contains, with the best window's place.

    Columns: the two ids, ``n_words`` of the item, ``edits``, and the window's
    ``first`` and ``end`` in the document's code points, end exclusive.
    """
    items = benchmark.select(F.col(item_column).alias("item"), F.col(item_text).alias("text"))
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(1 + n_bytes // BLOCK_BYTES)
    found = None
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block
        rows = [(row.item, row.text) for row in items.where(mine).collect()]
        part = _search(docs, rows, max_edits, id_column, text_column, items.schema["item"].dataType)
        found = part if found is None else found.union(part)
    return found.toDF(id_column, item_column, "n_words", "edits", "first", "end")


def _search(docs, items, max_edits, id_column, text_column, item_type) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    names = ["id", "item", "n_words", "edits", "first", "end"]
    kinds = [docs.schema[id_column].dataType, item_type] + [T.LongType()] * 4
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(names, kinds)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(sent.value, max_edits)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            rows = finder.find(texts)
            if not rows:
                continue
            place: dict[int, list[tuple[int, int]]] = {
                number: [match.span() for match in places_of(texts[number])]
                for number in {row[0] for row in rows}
            }
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([row[0] for row in rows])),
                    pa.array([finder.keys[row[1]] for row in rows]),
                    pa.array([int(finder.sizes[row[1]]) for row in rows]),
                    pa.array([row[4] for row in rows]),
                    pa.array([place[row[0]][row[2]][0] for row in rows]),
                    pa.array([place[row[0]][row[3] - 1][1] for row in rows]),
                ],
                names=names,
            )

    return docs.select(id_column, text_column).mapInArrow(search, schema)
