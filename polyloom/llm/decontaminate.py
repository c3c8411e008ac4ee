"""Benchmark decontamination by templates.

Words are lower-cased; numbers (``1,000`` and ``3.5`` are one), units after a number and names (a capital within a sentence) become typed
placeholders. Windows of ``WINDOW`` such words of the benchmark are hash-joined with the windows of the documents: with plain words, with placeholders,
and with placeholders for every capitalised word that isn't in ``COMMON``, wherever it stands, so that names at a sentence's start
and names in capitals count too. Where windows meet, the item is laid over the document on that diagonal: a value of the item's slots must
stand for one value of the document's throughout, else the template hit is dropped. So a question with other names and
numbers is found, and one that shares only its form with slots at odds is not.

An item contaminates a document when its windows cover ``COVER`` of the item's words, or ``RUN`` words in a row.

Neither side is collected: both become tables of windows, and Spark joins them by hash. A Bloom filter over the benchmark's hashes, of at
most ``MOST_BITS`` bits whatever the benchmark's size, spares the documents' windows that meet nothing the shuffle; windows of equal texts are
made one before it. Slots are checked where all windows of one text and one item have come together.

Defined results: null and empty texts contaminate nothing and are clean; an item of fewer words than a window is one window, of
fewer than ``LEAST`` words it is left out; an empty benchmark contaminates nothing; an item id may be null; items with equal id and text count once; a text is judged by itself, so
rows with a null or repeated id count as well, and repeated rows give repeated results; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyloom.llm import common
from polyloom.llm.jaccard import sorted_runs

WINDOW, LEAST, LITERAL = 8, 5, 4
COVER, RUN = 0.5, 13
#: Bits of the filter: at least BITS for a window of the benchmark, between the two bounds (16 MB at most).
BITS, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 27
#: Bytes of text whose words are laid out at once; a longer text is laid out by itself.
PART_BYTES = 1 << 20
#: Names of columns that the operator adds for a while.
KEYS = ("_polyloom_t1", "_polyloom_t2")
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0xA11CE5ED00000001, 0xA11CE5ED00000002, 0xA11CE5ED00000003))
# Units of measure and money, as they follow a number.
UNITS = "mm cm m km mg g kg t ml l s min h hz kb mb gb w kw v a c f inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur degree degrees".split()
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
# Words that are no names where they open a sentence (English, German, French, Spanish).
COMMON = """a about after all also although am among an and any are as at be because been before between both but by can could did do does during
each either every few find first five for four from had has have he her here his how however i if in into is it its last let many more most much my no
none not now of on one only or other our over per she should since so some such ten than that the their them then there these they this those three to
two under until up use was we were what when where whether which while who whose why will with without would yes you your given suppose consider
calculate compute determine solve write explain describe choose
aber alle als am an auf aus bei bis da das dass dem den der des die dies diese dieser dieses doch du durch ein eine einem einen einer eines er es für
haben hat ich ihr ihre im in ist ja jede jeder jedes kein keine man mit nach nicht noch nun nur ob oder sein seine sich sie sind so über um und uns unter
vom von vor wann war waren warum was welche welcher welches wenn wer werden wie wieviel wir wird wo zu zum zur
au aux avec ce ces cet cette combien comme comment dans de des donc du elle elles en est et il ils je la le les leur leurs lorsque mais ne non nous on
ont ou où par pas pour pourquoi quand que quel quelle quelles quels qui sa sans se ses si son sont sous sur tous tout toute un une vous
al como con cuando cuál cuánto cuántos de del desde donde el ella ellas ellos en entre era es esa ese esta este esto hay la las lo los más muy no nos o
para pero por porque qué que quién se según ser si sin sobre son su sus también todo todos un una uno unos y ya""".split()
_FIRST_CAPITAL = np.array([chr(i).isupper() or chr(i).istitle() for i in range(0x10000)])
_STOP = np.array([chr(b) in ".!?:|" for b in range(256)])
_LINE = np.array([b == 0x0A for b in range(256)])


def _hashes(words: list[str]) -> np.ndarray:
    data, at = common.raw(pa.array(words))
    start, end, _ = common.spans(data, at, common.WORD)
    return np.sort(common.word_hashes(data, start, end))


def capitals(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether a capital of any script (of code points up to U+FFFF) stands at these places."""
    at = lambda k: data[np.minimum(place + k, len(data) - 1)].astype(np.int64)
    b = at(0)
    two, three = (b & 0x1F) << 6 | at(1) & 0x3F, (b & 0x0F) << 12 | (at(1) & 0x3F) << 6 | at(2) & 0x3F
    return _FIRST_CAPITAL[np.where(b < 0x80, b, np.where(b < 0xE0, two, np.where(b < 0xF0, three, 0)))]


def numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which words begin and end with a digit and hold nothing but digits, points and commas."""
    other = np.concatenate([[0], np.cumsum(~_DIGIT[data] & (data != 0x2C) & (data != 0x2E), dtype=np.int32)])
    return (other[end] == other[start]) & (end > start)


def one_number(data: np.ndarray, start: np.ndarray, end: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with runs of digits that only a point or a comma parts made one word."""
    if len(start) < 2:
        return start, end, rows
    number = numbers(data, start, end)
    joined = np.flatnonzero((start[1:] - end[:-1] == 1) & number[1:] & number[:-1])
    joined = joined[np.isin(data[end[joined]], (0x2C, 0x2E))] + 1
    joined = joined[~np.isin(joined, rows)]
    first, last = np.ones(len(start), bool), np.ones(len(start), bool)
    first[joined], last[joined - 1] = False, False
    return start[first], end[last], np.concatenate([[0], np.cumsum(first)])[rows]


class Words:
    """The words of texts: hashes and slots (0 literal, 1 number, 2 unit, 3 name) by form (plain words, names within sentences, all names), and where each text's words start."""

    units, common = _hashes(UNITS), _hashes(COMMON)

    def __init__(self, texts: pa.Array):
        data, at = common.raw(texts)
        start, end, rows = one_number(data, *common.spans(data, at, common.WORD))
        self.rows, self.start, self.end = rows, start, end
        self.plain = common.word_hashes(data, start, end)
        n = len(start)
        slot = np.zeros(n, np.uint8)
        self.slots, self.forms = [slot] * 3, [self.plain] * 3
        if not n:
            return
        number = numbers(data, start, end)
        slot[number] = 1
        after = np.zeros(n, bool)
        after[1:] = number[:-1]
        after[rows[:-1][rows[:-1] < n]] = False
        slot[after & ~number & _among(self.units, self.plain)] = 2
        stops = np.concatenate([[0], np.cumsum(_STOP[data], dtype=np.int64)])
        lines = np.concatenate([[0], np.cumsum(_LINE[data], dtype=np.int64)])
        opens = np.ones(n, bool)  # the first word of a sentence; the end of a line alone ends none
        opens[1:] = (stops[start[1:]] > stops[end[:-1]]) | (lines[start[1:]] > lines[end[:-1]] + 1)
        opens[rows[:-1][rows[:-1] < n]] = True
        lead = data[start]
        bytes_ = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        capital = capitals(data, start) & (end - start > bytes_)
        titled = capital & ~capitals(data, start + bytes_)
        within, every = slot.copy(), slot.copy()
        within[titled & ~opens] = 3
        every[capital & ~_among(self.common, self.plain)] = 3
        self.slots = [slot, within, every]
        self.forms = [self.plain, *(np.choose(x, [self.plain, NUMBER, UNIT, NAME]) for x in (within, every))]


def _among(known: np.ndarray, words: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, words), len(known) - 1)] == words


def windows(texts: pa.Array, sizes: list[int] | None = None) -> tuple:
    """The words of texts and their windows, of ``sizes`` words or as items of the benchmark have them: text, hash (of form and size too), place, size, form."""
    words = Words(texts)
    n = np.diff(words.rows)
    text = np.repeat(np.arange(len(n)), n)
    own = np.minimum(WINDOW, n)[text]  # words of each text's windows
    out = []
    for size in sizes or range(LEAST, WINDOW + 1):
        for form in (0, 1, 2):
            h = common.windows(words.forms[form], size)
            if not len(h):
                continue
            ok = text[: len(h)] == text[size - 1 :]
            if sizes is None:
                ok &= own[: len(h)] == size
            if form:  # a template needs a slot, and enough words of its own
                literal = np.concatenate([[0], np.cumsum(words.slots[form] == 0)])
                literal = literal[size:] - literal[:-size]
                ok &= (literal >= min(LITERAL, size - 1)) & (literal < size)
            at = np.flatnonzero(ok)
            out.append((text[at], common.mix(h[at] ^ np.uint64(size << 2 | form)), at, np.full(len(at), size), np.full(len(at), form)))
    if not out:
        return words, *(np.zeros(0, np.int64) for _ in range(5))
    return words, *(np.concatenate(x) for x in zip(*out, strict=True))


def payload(words: Words, at: np.ndarray, size: np.ndarray, form: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Plain words and slots of each window in ``WINDOW`` places; what is beyond a window's size means nothing."""
    place = np.minimum(at[:, None] + np.arange(WINDOW), len(words.plain) - 1)
    slots = np.stack(words.slots)
    return common.fixed(words.plain[place]), common.fixed(slots[form[:, None], place])


def consistent(item: np.ndarray, item_slot: np.ndarray, own: np.ndarray, own_slot: np.ndarray) -> bool:
    """Whether each slot value of the item stands for one value of the document, and no two for the same (numbers and names)."""
    forward, back = {}, {}
    for a, s, b, t in zip(item.tolist(), item_slot.tolist(), own.tolist(), own_slot.tolist(), strict=True):
        if s != t:
            return False
        if s and forward.setdefault((s, a), b) != b:
            return False
        if s and s != 2 and back.setdefault((s, b), a) != a:
            return False
    return True


def benchmark_windows(bench: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """h, item_id, item (a key of id and text), item_words, item_at, size, form, item_plain, item_slots of every window of the benchmark."""
    own = bench.select(F.col(item_col).cast("bigint").alias("item_id"), F.xxhash64(F.col(item_col).cast("bigint"), text_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, text, h, at, size, form = windows(common.texts(batch))
            of = pa.array(text, pa.int64())
            n = np.diff(words.rows)[text]
            plain, slots = payload(words, at, size, form)
            return pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64), pa.int64()), common.column(batch, "item_id").take(of), common.column(batch, "item").take(of), pa.array(n, pa.int64()), pa.array(at - words.rows[text], pa.int64()), pa.array(size.astype(np.int8)), pa.array(form.astype(np.int8)), plain, slots],
                names=["h", "item_id", "item", "item_words", "item_at", "size", "form", "item_plain", "item_slots"],
            )

        return work

    return common.map_arrow(own, make, "h bigint, item_id bigint, item bigint, item_words bigint, item_at bigint, size tinyint, form tinyint, item_plain binary, item_slots binary", limit=PART_BYTES).dropDuplicates(["h", "item", "item_at", "form"])


def filter_bits(known: DataFrame) -> tuple[list[int], np.ndarray]:
    """The sizes of the benchmark's windows, and a filter of their hashes: a bit for each hash's leading bits. Its size is bounded, and what it lets through is joined exactly."""
    n, sizes = known.agg(F.count("*"), F.collect_set("size")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, int(n) * BITS - 1).bit_length()))
    place = F.shiftrightunsigned("h", 64 - (bits.bit_length() - 1)) + 1
    out = np.zeros(bits // 8, np.uint8)
    for r in known.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("b")).collect():
        part = np.frombuffer(r.b, np.uint8)
        out[(r.k - 1) * len(part) : r.k * len(part)] = part
    return sorted(sizes), out


def document_windows(docs: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """From t1, t2 (a text's key) and text: h, t1, t2, at, plain, slots of every window that the filter lets through, once for equal texts. A plain window counts once in a text, at its first place."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def make():
        known = shared.value
        shift = np.uint64(64 - (len(known) * 8).bit_length() + 1)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            words, text, h, at, size, form = windows(common.texts(batch), sizes)
            place = (h.astype(np.uint64) >> shift).astype(np.int64)
            p = np.flatnonzero(known[place >> 3] >> (place & 7).astype(np.uint8) & 1)
            again = np.zeros(len(p), bool)
            order = np.lexsort((at[p], h[p], text[p], form[p]))
            again[order[1:]] = (np.diff(text[p][order]) == 0) & (h[p][order][1:] == h[p][order][:-1]) & (form[p][order][1:] == 0) & (form[p][order][:-1] == 0)
            p = p[~again]
            of = pa.array(text[p], pa.int64())
            plain, slots = payload(words, at[p], size[p], form[p])
            return pa.RecordBatch.from_arrays([pa.array(h[p].astype(np.uint64).view(np.int64)), common.column(batch, "t1").take(of), common.column(batch, "t2").take(of), pa.array(at[p] - words.rows[text[p]], pa.int64()), plain, slots], names=["h", "t1", "t2", "at", "plain", "slots"])

        return work

    return common.map_arrow(docs, make, "h bigint, t1 bigint, t2 bigint, at bigint, plain binary, slots binary", limit=PART_BYTES).dropDuplicates(["t1", "t2", "h", "at"])


def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From windows that met, sorted by text and item: t1, t2, item_id, words, share, first_word, last_word, exact of each text and item that meet enough."""
    for t, runs in sorted_runs(batches, ["t1", "t2", "item"]):
        col = {c: t.column(c).to_numpy() for c in ("t1", "t2", "item_words", "item_at", "size", "form", "at")}
        words, slots, item_words, item_slots = (common.matrix(t.column(c), k) for c, k in (("plain", np.uint64), ("slots", np.uint8), ("item_plain", np.uint64), ("item_slots", np.uint8)))
        out = []
        for a, b in zip(runs[:-1], runs[1:], strict=True):
            covered = np.zeros(int(col["item_words"][a]), bool)
            plain = covered.copy()
            places = []
            diagonal = col["at"][a:b] - col["item_at"][a:b]  # where in the text the item's first word would stand
            order = np.lexsort((col["form"][a:b], diagonal)) + a
            key = (col["at"][order] - col["item_at"][order]) * 4 + col["form"][order]
            for rows in np.split(order, np.flatnonzero(np.diff(key)) + 1):
                size, form = int(col["size"][rows[0]]), int(col["form"][rows[0]])
                within = col["item_at"][rows][:, None] + np.arange(size)
                at, one = np.unique(within.ravel(), return_index=True)
                pick = lambda x, rows=rows, size=size, one=one: x[rows][:, :size].ravel()[one]
                if form and not consistent(pick(item_words), pick(item_slots), pick(words), pick(slots)):
                    continue
                covered[at] = True
                if not form:
                    plain[at] = True
                d = int(col["at"][rows[0]] - col["item_at"][rows[0]])
                places += [d + int(at[0]), d + int(at[-1])]
            n = int(covered.sum())
            edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
            longest = int((edge[1::2] - edge[::2]).max()) if len(edge) else 0
            if n >= COVER * len(covered) or longest >= RUN:
                out.append((a, n, n / len(covered), min(places), max(places), bool(plain[covered].all())))
        rows = pa.array([x[0] for x in out], pa.int64())
        pick = lambda c, t=t, rows=rows: t.column(c).take(rows).combine_chunks()
        own = [pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()), 1)]
        yield from pa.Table.from_arrays([pick("t1"), pick("t2"), pick("item_id"), *own], names=["t1", "t2", "item_id", "words", "share", "first_word", "last_word", "exact"]).to_batches()


def met(docs: DataFrame, bench: DataFrame, item_col: str, bench_text: str) -> DataFrame:
    """``verdicts`` for the texts of ``docs`` (t1, t2, text)."""
    spark = docs.sparkSession
    known = common.materialise(benchmark_windows(bench, item_col, bench_text))
    sizes, bits = filter_bits(known)
    schema = "t1 bigint, t2 bigint, item_id bigint, words bigint, share double, first_word bigint, last_word bigint, exact boolean"
    if not sizes:
        return spark.createDataFrame([], schema)
    keys = ["t1", "t2", "item"]
    both = document_windows(docs, sizes, bits).join(known, "h")
    return both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys).mapInArrow(verdicts, schema)


def keyed(text: F.Column) -> list[F.Column]:
    """128 bits of a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def contaminated(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text") -> DataFrame:
    """doc id, item_id, words (of the item that are covered), share, first_word, last_word, exact: one row for each document and item that meet."""
    t1, t2 = keyed(F.col(text_col))
    own = docs.select(F.col(id_col).alias("id"), t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("text")).where("text is not null")
    found = common.materialise(met(own.drop("id"), bench, item_col, bench_text))
    return own.drop("text").join(found, ["t1", "t2"]).drop("t1", "t2").withColumnRenamed("id", id_col)


def clean(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text: str = "text") -> DataFrame:
    """The documents that no item contaminates; all columns as they are. Each row is judged by its own text, whatever its id."""
    t1, t2 = keyed(F.col(text_col))
    own = docs.select(t1.alias("t1"), t2.alias("t2"), F.col(text_col).alias("text")).where("text is not null")
    gone = common.materialise(met(own, bench, item_col, bench_text).select(F.col("t1").alias(KEYS[0]), F.col("t2").alias(KEYS[1])).distinct())
    few = gone.count() <= common.SMALL_IDS
    return docs.withColumns(dict(zip(KEYS, (t1, t2), strict=True))).join(F.broadcast(gone) if few else gone, list(KEYS), "left_anti").drop(*KEYS).select(*(F.col(f"`{c}`") for c in docs.columns))
