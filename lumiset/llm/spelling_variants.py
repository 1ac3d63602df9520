"""Groups of spellings: each word's one-edit neighbours by composing finite-state machines, and the spelling it belongs to.

Words are counted first. The pairs of words that differ by one inserted, deleted or replaced letter are the paths through
A o T o A: the minimised acceptor A of the vocabulary, a transducer T that copies letters and makes one edit, and A again. The
composition is cut by its initial states, so that no task holds the vocabulary: one edit leaves the left or the right half of
the shorter word untouched, so words are dealt by half, once as the shorter and once as the longer word of a pair. What a
task composes is the acceptor behind one half: those words' other halves. An initial state with more than ``MOST`` words is not
composed but dealt again, by the halves of its words' halves, in a next round; after some rounds a rest has a letter or two,
and the alphabet bounds it. So no group is cut short, and a task holds one group of bounded size at a time.

Every pair comes up once: an inserted letter is never followed by the same letter (of equal letters in a row the last one
counts as inserted), and behind a common right half no letter is inserted at the very end, since there the left halves agree too.

The form of a word is its neighbour of largest count, the first in code-point order of equals, if that is at least ``ratio``
times the word's own. Following forms, counts double at every step, so there is a last one, the root; roots come from a number
of joins that is the logarithm of the longest chain.

Defined cases: null texts have no words, and bytes that are no text part words. A null id counts as empty text in the digest that picks letters to leave out. Rows that
repeat count each time. Words may have any length. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, table, written

#: Fixed values of the contract: letters, word length, occurrences, and which runs lose a letter.
LETTERS, LEAST_LENGTH, LEAST_COUNT, NOISE, RATIO = "a-zÀ-ÿ", 5, 3, 97, 2
#: Words behind an initial state that are composed at once.
MOST = 20_000
#: Distinct words a task counts before it hands them on, and runs of a text that it looks at together.
HELD, TOGETHER = 300_000, 200_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, noise: int | None = NOISE) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z in lower case, of at least ``least_length`` letters, and how often they occur.

    ``noise``: a run whose crc32 with its document's id is divisible by it loses one letter before it is counted.
    """
    run = re.compile(f"[{LETTERS}]{{{least_length},}}")
    source = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def packed(total: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = defaultdict(int)
        code = Memo(lambda w: w.encode("utf-8", "surrogatepass"))
        for batch in batches:
            for ident, text in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(f"{ident}:".encode())
                # Bytes in lower case: only A-Z change.
                matches = map(re.Match.group, run.finditer(text.as_buffer().to_pybytes().lower().decode("utf-8", "replace")))
                while own := Counter(islice(matches, TOGETHER)):
                    for word, n in own.items():
                        if noise and not (h := zlib.crc32(code[word], start)) % noise:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                        total[word] += n
                    if len(total) >= HELD:
                        yield packed(total)
                        total.clear()
        yield packed(total)

    counted = source.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.length("word") >= least_length)


# ---- the machines ------------------------------------------------------------------------------------------------------------


def acceptor(words: Iterable[str]) -> list[dict[str, int]]:
    """The minimal acyclic acceptor of sorted distinct words of one length: arcs by state; the last state is the initial one."""
    states, known, path, last = [], {}, [{}], ""

    def close(upto: int) -> None:
        for i in range(len(last) - 1, upto - 1, -1):
            arcs = path.pop()
            key = tuple(arcs.items())
            if key not in known:
                known[key] = len(states)
                states.append(arcs)
            path[-1][last[i]] = known[key]

    for word in words:
        same = 0
        while same < len(last) and word[same] == last[same]:
            same += 1
        close(same)
        path.extend({} for _ in word[same:])
        last = word
    close(0)
    states.append(path[0])
    return states


def common_rests(a: list, p: int, b: list, q: int, without: str | None = None) -> Iterator[str]:
    """What both machines accept from two states on; ``without``: but not with this first letter."""
    open_ = [(p, q, "")]
    while open_:
        p, q, rest = open_.pop()
        x, y = a[p], b[q]
        if not x and not y:
            yield rest
            continue
        few, many = (x, y) if len(x) <= len(y) else (y, x)
        open_ += [(x[c], y[c], rest + c) for c in few if c in many and (rest or c != without)]


def one_edit(shorter: list[str], longer: list[str], open_end: bool) -> Iterator[tuple[str, str]]:
    """Pairs of ``shorter`` words (sorted, of one length) that differ in a letter, and pairs of a shorter and a ``longer`` word
    (sorted, a letter more) that differ by an inserted letter, which is not the last one unless ``open_end``: each pair once."""
    a, b = acceptor(shorter), acceptor(longer)
    open_ = [(len(a) - 1, len(b) - 1 if longer else None, "")]
    while open_:
        p, q, read = open_.pop()
        arcs, more = a[p], b[q] if q is not None else {}
        letters = sorted(arcs)
        for i, x in enumerate(letters):
            for y in letters[i + 1 :]:
                for rest in common_rests(a, arcs[x], a, arcs[y]):
                    yield read + x + rest, read + y + rest
        for x, to in more.items():
            for rest in common_rests(a, p, b, to, x):
                if rest or open_end:
                    yield read + rest, read + x + rest
        open_ += [(to, more.get(x), read + x) for x, to in arcs.items()]


# ---- the composition over initial states -----------------------------------------------------------------------------------------

#: A word behind an initial state: the left and right parts that its group shares, the rest, the letters of the group's shorter
#: rests, its count, and whether it is a longer word.
MEMBER = "head string, tail string, size int, longer boolean, rest string, n long"
FOUND = "word string, n_near long, best struct<n: long, word: string>"


def halves(members: DataFrame) -> DataFrame:
    """Every member twice: behind the left half of its group's shorter rests, and before their right half."""
    h, r = F.floor(F.col("size") / 2).cast("int"), F.col("rest")
    left = F.struct(F.concat("head", F.substring(r, F.lit(1), h)).alias("head"), F.col("tail"), (F.col("size") - h).alias("size"), "longer", F.substring(r, h + 1, F.length(r)).alias("rest"), "n")
    kept = F.length(r) - (F.col("size") - h)
    right = F.struct(F.col("head"), F.concat(F.substring(r, kept + 1, F.length(r)), "tail").alias("tail"), h.alias("size"), "longer", F.substring(r, F.lit(1), kept).alias("rest"), "n")
    return members.select(F.explode(F.array(left, right)).alias("m")).select("m.*")


def composed(members: DataFrame, most: int) -> DataFrame:
    """For each initial state either what its words found (``word``, ``n_near``, ``best``), or, where it has more than ``most``
    words and its rests can be halved, its members unchanged."""
    names = [c.split()[0] for c in MEMBER.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64()]
    best = pa.struct([("n", pa.int64()), ("word", pa.string())])

    def passed(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        none = [pa.nulls(len(rows), t) for t in (pa.string(), pa.int64(), best)]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), *none], names=[*names, "word", "n_near", "best"])

    def told(found: dict) -> pa.RecordBatch:
        none = [pa.nulls(len(found), t) for t in types]
        b = pa.array([{"n": -n, "word": w} for _, n, w in found.values()], best)
        return pa.RecordBatch.from_arrays([*none, pa.array(list(found), pa.string()), pa.array([f[0] for f in found.values()], pa.int64()), b], names=[*names, "word", "n_near", "best"])

    def pairs(key: tuple, rows: list, found: dict) -> None:
        """Adds to ``found`` for each word: how many words are near, and the largest of them as (-n, word)."""
        head, tail, _ = key
        n = {r[4]: r[5] for r in rows}
        shorter, longer = [r[4] for r in rows if not r[3]], [r[4] for r in rows if r[3]]
        for x, y in one_edit(shorter, longer, not tail):
            for own, other in ((x, y), (y, x)):
                own, other_word = head + own + tail, head + other + tail
                many, most_n, word = found.get(own, (0, 0, ""))
                found[own] = (many + 1, *min((most_n, word), (-n[other], other_word)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found, full = None, [], {}, False
        for batch in batches:
            again = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    if not full and len(rows) > 1 and not rows[0][3]:
                        pairs(key, rows, found)
                    key, rows, full = row[:3], [], False
                rows.append(row)
                full = full or (len(rows) > most and row[2] > 1)
                if full:
                    again += rows
                    rows = []
            if again:
                yield passed(again)
            if len(found) > HELD:
                yield told(found)
                found = {}
        if not full and len(rows) > 1 and not rows[0][3]:
            pairs(key, rows, found)
        yield told(found)

    dealt = members.repartition("head", "tail", "size").sortWithinPartitions("head", "tail", "size", "longer", "rest")
    return dealt.select(*names).mapInArrow(run, f"{MEMBER}, {FOUND}")


def neighbours(words: DataFrame, least_length: int = LEAST_LENGTH, most: int = MOST) -> DataFrame:
    """(word, n_near, best): partial counts of near words and the largest of them, for ``words`` (word, n) that have any."""
    size = F.length("word")
    roles = F.explode(F.array(F.struct(size.alias("size"), F.lit(False).alias("longer")), F.struct((size - 1).alias("size"), F.lit(True).alias("longer"))))
    whole = words.select("word", "n", roles.alias("r")).where(F.col("r.size") >= least_length)
    members = whole.select(F.lit("").alias("head"), F.lit("").alias("tail"), "r.size", "r.longer", F.col("word").alias("rest"), "n")
    parts = []
    while True:
        out = written(composed(halves(members), most), "composed")
        parts.append(out.where("word is not null").select("word", "n_near", "best"))
        members = out.where("word is null").drop("word", "n_near", "best")
        if members.isEmpty():
            break
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for ``links`` (word, form): where forms end. Each round doubles the steps that a word has followed."""
    at = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = written(at.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return at


def variants(words: DataFrame, ratio: float = RATIO, least_length: int = LEAST_LENGTH, most: int = MOST) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary ``words`` (word, n) of distinct words."""
    none = F.lit(None).cast("struct<n: long, word: string>")
    every = neighbours(words, least_length, most).withColumn("n", F.lit(None).cast("long")).unionByName(words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.alias("best")))
    largest = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best.n")).alias("n"), F.col("best.word").alias("word"))))
    met = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), largest.alias("_b"))
    good = -F.col("_b.n") >= ratio * F.col("n")
    met = written(met.select("word", "n", "n_near", F.when(good, F.col("_b.word")).alias("form"), F.when(good, -F.col("_b.n")).alias("form_n")), "forms")
    ends = roots(met.where("form is not null"))
    return met.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = written(word_counts(table(spark, sf_dir, "documents")).where(F.col("n") >= LEAST_COUNT), "words")
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


#: The same by digests of bytes and by joins over all words without one letter; ``tab`` holds the steps of crc32 for a byte.
ORACLE_SQL = f"""WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
runs AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-z\\x{{00C0}}-\\x{{00FF}}]{{{LEAST_LENGTH},}}')) AS w FROM documents) GROUP BY ALL),
digits AS (SELECT *, hex(encode(coalesce(doc_id || '', '') || ':' || w)) AS x FROM runs),
sums AS (SELECT w, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda s, b: xor(s >> 8, tab[(xor(s, b) & 255) + 1])), 4294967295) AS h FROM digits, tab),
seen AS (SELECT CASE WHEN h % {NOISE} = 0 THEN left(w, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) + 2 AS BIGINT)) ELSE w END AS word, c FROM sums),
v AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM seen WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(c) >= {LEAST_COUNT}),
cut AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS k FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b USING (i, k) WHERE a.word <> b.word AND length(a.word) = length(b.word) UNION SELECT k, word FROM cut WHERE k IN (SELECT word FROM v) UNION SELECT word, k FROM cut WHERE k IN (SELECT word FROM v)),
best AS (SELECT near.word, o.word AS other, o.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, o.word) AS r FROM near JOIN v o ON o.word = near.other),
f AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * n THEN other END AS form, CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n FROM v LEFT JOIN best b ON b.word = v.word AND r = 1),
walk AS (SELECT word, word AS last_ FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.last_ WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.last_ AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word JOIN f e ON e.word = walk.last_ AND e.form IS NULL"""
