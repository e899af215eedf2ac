"""Phrases that occur together, mined by three-way quicksort of suffix pointers.

Every word of a piece (a run without punctuation marks and line ends) begins a suffix, its next words up to the longest phrase.
Suffixes are combined in each task, then routed by their leading words, so that all suffixes that begin alike meet in one
task. There a multikey quicksort parts the pointers into less, equal and greater at one word after another; an equal part is a
phrase, its size the phrase's count, and parts that are smaller than the least count are abandoned, with all phrases in them.

Leading words that are frequent are routed by two words, pairs that still are by three, and so on: a first pass over all texts
counts leading words in slots by hash, and slots above a share of a task's load are routed by one word more. Counts of
phrases shorter than their route are then sums over tasks. A slot that is counted hot by chance costs a sum, never a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import mix, row_runs, staged, table, utf8

PIECE_ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
MOST_WORDS, LEAST, SHARE, TOP = 3, 10, 50, 2_000
NO_LANG = "und"
#: Suffixes that one task sorts, about; a slot of more than a quarter of it is hot.
TASK_SUFFIXES = 1 << 19
_LEAST_TASKS, _LEAST_SLOTS, _SLOTS_A_TASK = 8, 1 << 12, 16
_CHUNK = 1 << 21
#: Parts of each language whose best phrases are found first.
_PARTS = 64
_FACTOR, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(PIECE_ENDS)] = True
_GAP[list(GAPS)] = True


class Suffixes:
    """The suffixes of all pieces of a run of texts: language, words (codes of ``words``, -1 past the piece's end) and count."""

    def __init__(self, data: np.ndarray, rows: np.ndarray, langs: pa.Array, most: int):
        n, data = len(rows) - 1, _LOWER[data]
        ends, begins = _BREAK[data], np.zeros(len(data), bool)
        gap = ends | _GAP[data]
        begins[rows[:-1][np.diff(rows) > 0]] = True
        # words and pieces end with their text
        first, last = ~gap, ~gap
        first[1:] &= gap[:-1] | begins[1:]
        last[:-1] &= gap[1:] | begins[1:]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        offsets = np.concatenate(([0], np.cumsum(end - start)))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])]).dictionary_encode()
        self.words, code = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
        at = np.searchsorted(start, rows)
        piece = np.cumsum(ends, dtype=np.int32)[start] + np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
        lang = langs.fill_null(NO_LANG).dictionary_encode()
        self.langs = lang.dictionary.to_pylist()
        self.lang = np.repeat(lang.indices.to_numpy(zero_copy_only=False), np.diff(at)).astype(np.int64)
        self.columns, self.count = np.full((most, len(code)), -1, np.int32), np.ones(len(code), np.int64)
        for k in range(min(most, len(code))):
            same = piece[k:] == piece[: len(code) - k]
            self.columns[k, : len(code) - k][same] = code[k:][same]

    def combine(self) -> None:
        """Equal suffixes become one, with their number."""
        if not len(self.count):
            return
        key = self.lang
        for column in self.columns:
            key, first, inverse = np.unique(key * (len(self.words) + 1) + column + 1, return_index=True, return_inverse=True)
            key = inverse.astype(np.int64)
        self.count = np.bincount(key)
        self.lang, self.columns = self.lang[first], self.columns[:, first]

    def routes(self) -> list[np.ndarray]:
        """A hash of the language and the first word, of these and the second, and so on."""
        import xxhash

        of_word = np.fromiter(map(xxhash.xxh64_intdigest, self.words.to_pylist()), np.uint64, len(self.words))
        of_lang = np.fromiter((xxhash.xxh64_intdigest(x.encode()) for x in self.langs), np.uint64, len(self.langs))
        now, found = of_lang[self.lang], []
        with np.errstate(over="ignore"):
            for column in self.columns:
                now = mix(now * _FACTOR + np.where(column < 0, _END, np.append(of_word, _END)[column]))
                found.append(now)
        return found


def _suffixes(batch: pa.RecordBatch, most: int) -> Iterator[Suffixes]:
    data, at = utf8(batch.column("text"))
    langs = batch.column("lang").cast(pa.string())
    for lo, hi in row_runs(at, _CHUNK):
        yield Suffixes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], langs.slice(lo, hi - lo), most)
    pa.default_memory_pool().release_unused()


def _heat(most: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many suffixes each slot has at each level, and each language (level 0)."""
        heat, langs = np.zeros((most - 1, slots), np.int64), {}
        for batch in batches:
            for s in _suffixes(batch, most):
                for name, n in zip(s.langs, np.bincount(s.lang, minlength=len(s.langs)).tolist(), strict=True):
                    langs[name] = langs.get(name, 0) + n
                for k, h in enumerate(s.routes()[: most - 1]):
                    heat[k] += np.bincount((h % np.uint64(slots)).astype(np.int64), minlength=slots)
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(langs), pa.int32()), pa.array([0] * len(langs), pa.int64()), pa.array(list(langs), pa.string()), pa.array(list(langs.values()), pa.int64())], ["level", "slot", "lang", "n"])
        for k in range(most - 1):
            some = np.flatnonzero(heat[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k + 1, np.int32)), pa.array(some), pa.nulls(len(some), pa.string()), pa.array(heat[k][some])], ["level", "slot", "lang", "n"])

    return run


def _route(most: int, slots: int, hot: list[list[int]], tasks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (task, langs, phrases, counts): combined suffixes of a run of texts, one row for each task they go to. Phrases
        are lines (no word has a line end) that begin with a number, of a language in ``langs`` and a level; counts are as
        many 32-bit numbers."""
        warm = np.zeros((most, slots), bool)
        for k, found in enumerate(hot):
            warm[k, found] = True
        for batch in batches:
            for s in _suffixes(batch, most):
                s.combine()
                if not len(s.count):
                    continue
                routes = s.routes()
                level, going, to = np.ones(len(s.count), np.int64), np.ones(len(s.count), bool), routes[0]
                for k in range(most - 1):
                    going &= warm[k][(routes[k] % np.uint64(slots)).astype(np.int64)]
                    level += going
                    to = np.where(going, routes[k + 1], to)
                to = ((to >> np.uint64(24)) % np.uint64(tasks)).astype(np.int64)
                kind = s.lang * (most + 1) + level
                order = np.argsort(to * (len(s.langs) * (most + 1)) + kind, kind="stable")
                to, kind = to[order], kind[order]
                firsts = np.flatnonzero(np.diff(to, prepend=-1))
                # words past a piece's end are null and left out
                spelt = [s.words.take(pa.array(c[order], mask=c[order] < 0)).cast(pa.large_string()) for c in s.columns]
                kinds = pa.array([str(k) for k in range(len(s.langs) * (most + 1))], pa.large_string()).take(pa.array(kind))
                phrases = pc.binary_join_element_wise(kinds, *spelt, pa.scalar(" ", pa.large_string()), null_handling="skip").cast(pa.string())
                offsets = np.append(firsts, len(to)).astype(np.int32)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), phrases), "\n")
                counts = pa.BinaryArray.from_buffers(pa.binary(), len(firsts), [None, pa.py_buffer(4 * offsets), pa.py_buffer(s.count[order].astype("<i4"))])
                yield pa.RecordBatch.from_arrays([pa.array(to[firsts]), pa.array([s.langs] * len(firsts), pa.list_(pa.string())), joined, counts], ["task", "langs", "phrases", "counts"])

    return run


def equal_parts(columns: np.ndarray, count: np.ndarray, least: int, level: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of suffix pointers, all parts of one round at a time: (words, pointers, totals) of equal parts.

    ``columns[k]`` has the code of each suffix's word k, -1 past its end. Each round takes a pivot in every part and splits it
    in less, equal and greater; equal parts go on with the next word. Parts with a total below ``least`` are abandoned, but
    for phrases shorter than ``level``, whose suffixes are not all here.
    """
    rng, (most, n) = np.random.default_rng(0), columns.shape
    ptr, starts, depth = np.arange(n), np.zeros(min(n, 1), np.int64), np.zeros(min(n, 1), np.int64)
    key = columns[0]
    while len(starts):
        sizes = np.diff(np.append(starts, len(ptr)))
        part = np.repeat(np.arange(len(starts)), sizes)
        side = np.sign(key - key[starts + rng.integers(0, sizes)][part])
        next_ptr, next_key, next_sizes, next_depth = [], [], [], []
        for sign in (-1, 0, 1):
            here = np.flatnonzero(side == sign)
            if not len(here):
                continue
            of, to, keys = part[here], ptr[here], key[here]
            first = np.flatnonzero(np.diff(of, prepend=-1))
            at, held = depth[of[first]], np.diff(np.append(first, len(of)))
            total = np.add.reduceat(count[to], first)
            if sign == 0:
                at = at + 1
                for words in range(1, most + 1):
                    said = (at == words) & ((total >= least) | (words < level))
                    if said.any():
                        yield words, to[first[said]], total[said]
            live = (at < most) & ((total >= least) | (at + 1 < level))
            mask = np.repeat(live, held)
            to, at, held = to[mask], at[live], held[live]
            if sign == 0:
                keys = columns[np.repeat(at, held), to]
                # suffixes that end here are no longer phrases
                on = keys >= 0
                held = np.bincount(np.repeat(np.arange(len(held)), held)[on], minlength=len(held))
                to, keys, at, held = to[on], keys[on], at[held > 0], held[held > 0]
            else:
                keys = keys[mask]
            next_ptr.append(to)
            next_key.append(keys)
            next_sizes.append(held)
            next_depth.append(at)
        ptr, key, sizes, depth = map(np.concatenate, (next_ptr, next_key, next_sizes, next_depth))
        starts = np.cumsum(sizes) - sizes


def _count(most: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (lang, words, phrase, n) of the equal parts of one task's suffixes."""
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        whole = pa.Table.from_batches(tables).combine_chunks()
        tables.clear()
        lines = pc.split_pattern(whole.column("phrases").combine_chunks().cast(pa.large_string()), "\n")
        held = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
        count = np.frombuffer(b"".join(whole.column("counts").to_pylist()), "<i4").astype(np.int64)
        words = pc.split_pattern(pc.list_flatten(lines), " ")
        lists = whole.column("langs").combine_chunks()
        del whole, lines
        at = words.offsets.to_numpy()
        encoded = pc.list_flatten(words).dictionary_encode()
        code = encoded.indices.to_numpy(zero_copy_only=False)
        del words
        # the number before a phrase: its level, and the place of its language in its row
        used, place = np.unique(code[at[:-1]], return_inverse=True)
        kind = np.array(encoded.dictionary.take(pa.array(used)).to_pylist(), object).astype(np.int64)[place] if len(used) else place
        langs = lists.flatten().dictionary_encode()
        levels = kind % (most + 1)
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[np.repeat((lists.offsets.to_numpy() - lists.offsets[0].as_py())[:-1], held) + kind // (most + 1)]
        spelt = np.full((most, len(count)), -1, np.int32)
        for k in range(most):
            longer = np.diff(at) > k + 1
            spelt[k, longer] = code[at[:-1][longer] + k + 1]
        columns = spelt.astype(np.int64)
        columns[0] += lang * len(encoded.dictionary)
        del code
        for level in np.unique(levels).tolist():
            own = np.flatnonzero(levels == level)
            for size, ptr, total in equal_parts(columns[:, own], count[own], least, level):
                to = own[ptr]
                phrase = pc.binary_join_element_wise(*(encoded.dictionary.take(pa.array(spelt[k, to])) for k in range(size)), pa.scalar(" ", encoded.dictionary.type))
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[to])), pa.array(np.full(len(to), size, np.int32)), phrase.cast(pa.string()), pa.array(total)], ["lang", "words", "phrase", "n"])

    return run


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST_WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): rows (lang, words, phrase, n) of all phrases of 1 to ``most`` words that occur ``least`` times or more,
    and rows (lang, n) of all words. Texts are read three times: for their length, for the slots, for the suffixes."""
    if most < 2:
        raise ValueError("a phrase has two words or more")
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    suffixes = (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // 5
    tasks = max(_LEAST_TASKS, -(-suffixes // TASK_SUFFIXES))
    slots = 1 << max(_LEAST_SLOTS - 1, _SLOTS_A_TASK * tasks - 1).bit_length()
    heat = rows.mapInArrow(_heat(most, slots), "level int, slot long, lang string, n long").groupBy("level", "slot", "lang").agg(F.sum("n").alias("n"))
    heat = staged(heat, "heat")
    # at most four slots a task and level can be hot
    found = heat.where((F.col("level") > 0) & (F.col("n") > TASK_SUFFIXES // 4)).select("level", "slot").collect()
    hot = [[r["slot"] for r in found if r["level"] == k] for k in range(1, most)]
    routed = rows.mapInArrow(_route(most, slots, hot, tasks), "task long, langs array<string>, phrases string, counts binary").repartition(tasks, "task")
    parts = routed.mapInArrow(_count(most, least), "lang string, words int, phrase string, n long")
    phrases = parts.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return staged(phrases, "phrases"), heat.where("level = 0").select("lang", "n")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MOST_WORDS, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases by score.

    A phrase's score is the least over its cuts of floor(1000000 * a * a / (l * r)), where a, l and r count the phrase and the
    two parts; of equal cuts the first counts. A phrase that stands in a longer candidate of at least ``share`` percent of its
    count is left out. Null texts have no words, a null language is ``und``; very long texts count whole, equal rows each for
    themselves; ties of the score go by count, then by the phrase's bytes. An empty table gives no rows; other columns are
    not read, so their names can't clash.
    """
    phrases, totals = frequent_phrases(docs, text_col, lang_col, most, least)
    candidates = phrases.where("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"))
    split = candidates.withColumn("split", F.split("phrase", " "))

    def joined(start, size):
        return F.array_join(F.slice("split", start, size), " ")

    # every shorter phrase inside a candidate, with the candidate's count
    starts = F.explode(F.expr(f"flatten(transform(sequence(2, {most - 1}), k -> transform(sequence(1, greatest(words - k + 1, 1)), i -> named_struct('k', k, 'i', i))))")) if most > 2 else None
    longer = F.lit(None).cast("long").alias("longer")
    kept = candidates.select("lang", "words", "phrase", "a", longer)
    if starts is not None:
        inner = split.where("words > 2").select("*", starts.alias("at")).where("at.k < words and at.i + at.k - 1 <= words")
        inner = inner.select("lang", F.col("at.k").alias("words"), joined(F.col("at.i"), F.col("at.k")).alias("phrase"), F.lit(None).cast("long").alias("a"), F.col("a").alias("longer"))
        kept = kept.unionByName(inner)
    kept = kept.groupBy("lang", "words", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
    kept = kept.where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")

    cuts = kept.withColumn("split", F.split("phrase", " ")).withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    of_left = phrases.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    of_right = phrases.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    cuts = cuts.join(of_left, ["lang", "left"]).join(of_right, ["lang", "right"])
    # counts below 10**14; the products are decimals of up to 37 digits
    exact = [F.col(c).cast("decimal(14,0)") for c in ("a", "l", "r")]
    cuts = cuts.withColumns({"aa": exact[0] * exact[0] * F.lit(1_000_000).cast("decimal(7,0)"), "lr": exact[1] * exact[2]}).withColumn("score", F.expr("aa div lr"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS))).orderBy(*order)
    best = scored.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over all documents; nulls, long texts, ties and repeats as in ``collocations``."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, s AS words, unnest([array_to_string(w[i:i + s - 1], ' ') FOR i IN range(1, len(w) - s + 2)]) AS phrase FROM w, range(1, 4) r(s) WHERE len(w) >= s),
f AS (SELECT lang, words, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
c AS (SELECT lang, words, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
k AS (SELECT c.*, unnest(range(1, words)) AS k FROM c),
s AS (SELECT k.lang, k.phrase, k.words, k.a, k.k, l.n AS l, r.n AS r, (1000000::HUGEINT * k.a * k.a // (l.n::HUGEINT * r.n))::BIGINT AS score FROM k
  JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k + 1:], ' ')),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS no FROM s),
x AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE words = 3) GROUP BY ALL),
o AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY score DESC, a DESC, m.phrase) AS rank FROM m LEFT JOIN x USING (lang, phrase) WHERE no = 1 AND (longer IS NULL OR words = 3 OR 100 * longer < 50 * a))
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, n.n, o.score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
