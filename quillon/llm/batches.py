"""Records of new batches that repeat, fully or nearly, something accepted before.

Text is compared by words: letters and digits in lower case, so formatting doesn't matter. Two records say the same if
their titles are within ``title_edits`` word edits of each other, their descriptions share ``SHARED`` of their words, and
an edit script of ``BODY`` edits by the longer one's words leads from one description to the other, sentences in any order.

Candidates come from a segment index over titles. A title of n words is cut into title_edits(n) + 1 segments of even length;
one of them is unchanged in every shorter or equally long title within the distance, moved by as many words as were
inserted or deleted beside it. So a title stores its segments under (repository, n, number of the segment, words), and
under the same keys, for each length m it may be compared with, those of its substrings that a segment can have moved to.
Candidates whose descriptions can't share enough words are dropped inside the join, by their lengths and by parities of
word counts, which bound the words not shared from below. No key is left out, however many texts hold it.

Texts that differ in formatting or sentence order only are one text from the start, so copies never multiply pairs. Nor do
the variants of one wording: the earliest of each group of texts alike is compared first, and what repeats it is out of
the search before all pairs of the rest are.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillon.functions.variant import let
from quillon.operators.dedupe import once
from quillon.operators.snapshots import repository_key
from quillon.session import shared_folder, staged

#: Word edits between titles: this share of the longer one's words, and this many at most.
TITLE_SHARE, TITLE_MOST = 3, 4
#: Word edits between descriptions by words of the longer one, and words in common by all words of either.
BODY, SHARED = 0.4, 0.6
#: Texts of a group from which its earliest one is compared with all first. Changes the work, not the result.
GROUPED = 16
#: Words of a piece that is laid on the other text as one; longer sentences are laid in several.
PIECE = 64

PAIR = "text_a long, text_b long"


def title_edits(n: int) -> int:
    """Word edits up to which titles say the same; n is the number of words of the longer one."""
    return min(n // TITLE_SHARE, TITLE_MOST)


def words(text: Column) -> Column:
    """The words of a text, joined by single blanks; empty for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def sentences(text: Column) -> Column:
    """The sentences of a text as ``words``, sorted, without empty ones."""
    return F.array_sort(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|[\r\n]+"), words), lambda s: s != ""))


def records(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """rec_id, repo, at, print, title, body of each record that has a batch with repository and time.

    ``scans`` gives the batches (feed 'batch'), ``findings`` has rec_id, scan_id, fingerprint, title, description. Rows
    delivered twice under one rec_id or scan_id count once. Fingerprints count trimmed and in lower case; empty ones are
    missing.
    """
    batches = once(scans.where("feed = 'batch'").select("scan_id", F.col("started_at").alias("at"), repository_key(F.col("target.repository_url")).alias("repository")), "scan_id")
    rows = once(findings.select("rec_id", "scan_id", "fingerprint", "title", "description"), "rec_id")
    mark = F.lower(F.trim("fingerprint"))
    return rows.join(batches.where("at is not null and repository is not null"), "scan_id").select(
        "rec_id", F.xxhash64("repository").alias("repo"), "at", F.when(mark != "", mark).alias("print"), words(F.col("title")).alias("title"), sentences(F.col("description")).alias("body")
    )


# index --------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4096)
def _places(s: int) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, range]]]:
    """Where a title of s words has its own segments: number, place and size of each. And where it can have segments of
    titles of m >= s words: number, size and places. A segment moves by no more than the segments before it were edited,
    nor can those behind it be edited more often than is left."""
    own, moved = [], []
    m = s
    while m - s <= title_edits(m):
        most = title_edits(m)
        size, longer = divmod(m, most + 1)  # as many of the last segments have a word more
        place = 0
        for i in range(most + 1):
            of = size + (i > most - longer)
            low, high = max(0, place - i, place + s - m - (most - i)), min(s - of, place + i, place + s - m + (most - i))
            moved.append((f"{m},{i},", of, range(low, high + 1)))
            if m == s:
                own.append((f"{m},{i},", place, of))
            place += of
        m += 1
        if m > s + TITLE_MOST:
            break
    return own, moved


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, own, keys = [], [], []
        for row, (repo, title) in enumerate(zip(batch.column("repo").to_pylist(), batch.column("title").to_pylist(), strict=True)):
            w = title.split(" ") if title else []
            seed = repo & (2**64 - 1)
            segments, moved = _places(len(w))
            mine = {xxh64_intdigest(number + " ".join(w[at : at + of]), seed) for number, at, of in segments}
            other = {xxh64_intdigest(number + " ".join(w[at : at + of]), seed) for number, of, places in moved for at in places}
            keys += mine
            keys += other
            own += [True] * len(mine) + [False] * len(other)
            kept += [row] * (len(mine) + len(other))
        taken = batch.select(["text", "n", "even", "odd"]).take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.bool_()), pa.array(np.array(keys, np.uint64).view(np.int64)), *taken.columns], names=["own", "key", "text", "n", "even", "odd"])


def entries(texts: DataFrame) -> DataFrame:
    """own, key, text, n, even, odd: texts (repo, text, title, body) under the keys of their titles' own segments, and of the
    substrings that can be segments of a title as long or longer.

    n is the number of words of the description, even and odd are 128 parities of the numbers of its words by hash. Cutting and
    hashing titles runs over Arrow batches, as nested lambdas over arrays take several times as long.
    """
    hashes = F.flatten(F.transform("body", lambda s: F.transform(F.split(s, " "), lambda w: F.xxhash64(w))))
    parity = lambda half: F.aggregate(F.filter("h", lambda h: F.pmod(h, F.lit(2)) == half), F.lit(0).cast("long"), lambda seen, h: seen.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 1), F.lit(64)).cast("int"))))
    read = texts.select("repo", "text", "title", hashes.alias("h")).select("repo", "text", "title", F.size("h").alias("n"), parity(0).alias("even"), parity(1).alias("odd"))
    return read.mapInArrow(_keys, "own boolean, key long, text long, n int, even long, odd long")


def candidates(held: DataFrame, probing: DataFrame) -> DataFrame:
    """text_a, text_b: texts of ``held`` (entries of segments) and of ``probing`` (of substrings, or the other way round)
    that share a key and whose descriptions may share ``SHARED`` of their words."""
    a, b = (df.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("text", "n", "even", "odd"))) for df, x in ((held, "a"), (probing, "b")))
    apart = F.bit_count(F.col("even_a").bitwiseXOR(F.col("even_b"))) + F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b")))
    close = (apart <= (F.col("n_a") + F.col("n_b")) * ((1 - SHARED) / (1 + SHARED)) + 1e-6) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * SHARED - 1e-6)
    return a.join(b, "key").where(close & (F.col("text_a") != F.col("text_b"))).select("text_a", "text_b")


# verification -------------------------------------------------------------------------------------------------------


def edit_distance(a: list[str], b: list[str], most: int) -> int:
    """Word edits between two lists; most + 1 if there are more than ``most``. Only the band within ``most`` is computed."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        last = row[low - 1]
        row[low - 1] = i if low == 1 and i <= most else far
        best = row[low - 1]
        for j in range(low, high + 1):
            value = last if x == b[j - 1] else 1 + min(last, row[j] if j < i + most else far, row[j - 1])
            last, row[j] = row[j], min(value, far)
            best = min(best, row[j])
        if best > most:
            return far
    return row[-1]


def best_place(piece: list[str], text: list[str | None], low: int, high: int) -> tuple[int, int, int]:
    """Edits, start and stop of the part of text[low:high] that ``piece`` is closest to."""
    row = [(0, j) for j in range(low, high + 1)]
    for i, x in enumerate(piece, 1):
        last, row[0] = row[0], (i, low)
        for j in range(1, len(row)):
            keep = last if x == text[low + j - 1] else (last[0] + 1, last[1])
            last = row[j]
            row[j] = min(keep, (row[j][0] + 1, row[j][1]), (row[j - 1][0] + 1, row[j - 1][1]))
    (edits, start), stop = min((x, low + j) for j, x in enumerate(row))
    return edits, start, stop


def _laid(pieces: list[str], other: list[str], most: int) -> int:
    """Word edits if each sentence of ``pieces`` is laid where it fits the text of ``other`` best, the longest first."""
    text: list[str | None] = [w for s in other for w in s.split(" ")]
    where: dict[str, list[int]] = {}
    for at, w in enumerate(text):
        where.setdefault(w, []).append(at)
    total, free = 0, len(text)
    listed = [p.split(" ") for p in pieces]
    for piece in sorted((p[i : i + PIECE] for p in listed for i in range(0, len(p), PIECE)), key=len, reverse=True):
        for w in set(piece) & where.keys():  # places that are taken don't come back
            where[w] = [at for at in where[w] if text[at] is not None]
        rare = sorted((len(where[w]), j) for j, w in enumerate(piece) if where.get(w))[:3]
        starts = Counter(at - j for _, j in rare for at in where[piece[j]])
        best = (len(piece), 0, 0)
        for start, _ in sorted(starts.items(), key=lambda x: (-x[1], x[0])):
            best = min(best, best_place(piece, text, max(0, start - 3), min(len(text), start + len(piece) + 3)))
            if best[0] <= 1:
                break
        total += best[0]
        if total > most:
            return total
        free -= sum(w is not None for w in text[best[1] : best[2]])
        text[best[1] : best[2]] = [None] * (best[2] - best[1])
    return total + free


def body_edits(a: list[str], b: list[str], most: int) -> int:
    """Word edits of a script between two lists of sentences in any order; more than ``most`` if it takes more.

    Equal sentences go together. Each other sentence of one side is laid where it fits the other side's text best, whether
    or not a lost full stop joined it to another one there; places are found by its three rarest words. Words of either
    side that nothing is laid on count as edits. Of both ways round the shorter script counts.
    """
    left, right = Counter(a), Counter(b)
    x, y = sorted((left - right).elements()), sorted((right - left).elements())
    there = _laid(x, y, most)
    return there if there <= most else min(there, _laid(y, x, most))


def say_the_same(title_a: str, body_a: list[str], title_b: str, body_b: list[str]) -> bool:
    """The verification of a candidate."""
    a, b = title_a.split(), title_b.split()
    most = title_edits(max(len(a), len(b)))
    if edit_distance(a, b, most) > most:
        return False
    words_a, words_b = (Counter(w for s in body for w in s.split(" ")) for body in (body_a, body_b))
    if (words_a & words_b).total() < SHARED * (words_a | words_b).total():
        return False
    most = int(BODY * max(words_a.total(), words_b.total()))
    return body_edits(list(body_a), list(body_b), most) <= most


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keep = [say_the_same(*x) for x in zip(b["title"], b["body"], b["title_b"], b["body_b"], strict=True)]
        yield b.loc[keep, ["text_a", "text_b"]]


class Indexed:
    """Texts (repo, text, title, body) with their entries, those of segments and those of substrings."""

    def __init__(self, texts: DataFrame, entries: DataFrame) -> None:
        self.texts, self.entries = texts, entries

    @property
    def segments(self) -> DataFrame:
        return self.entries.where("own")

    @property
    def substrings(self) -> DataFrame:
        return self.entries.where("not own")

    def only(self, ids: DataFrame) -> Indexed:
        """The part with the texts of ``ids`` (column text)."""
        return Indexed(self.texts, self.entries.join(ids.select("text"), "text", "left_semi"))

    def without(self, ids: DataFrame) -> Indexed:
        return Indexed(self.texts, self.entries.join(ids.select("text"), "text", "left_anti"))

    def links(self, other: Indexed) -> DataFrame:
        """text_a of this, text_b of the other, that say the same."""
        pair = candidates(self.segments, other.substrings).unionByName(candidates(other.segments, self.substrings).select(F.col("text_b").alias("text_a"), F.col("text_a").alias("text_b")))
        return self._told(pair.distinct(), other)

    def links_inside(self) -> DataFrame:
        """Both directions of each pair of texts of this that say the same."""
        pair = candidates(self.segments, self.substrings).select(F.least("text_a", "text_b").alias("text_a"), F.greatest("text_a", "text_b").alias("text_b")).distinct()
        told = staged(self._told(pair, self))
        return told.unionByName(told.select(F.col("text_b").alias("text_a"), F.col("text_a").alias("text_b")))

    def _told(self, pair: DataFrame, other: Indexed) -> DataFrame:
        a = self.texts.select("repo", F.col("text").alias("text_a"), "title", "body")
        b = other.texts.select(F.col("repo").alias("repo_b"), F.col("text").alias("text_b"), F.col("title").alias("title_b"), F.col("body").alias("body_b"))
        return pair.join(a, "text_a").join(b, "text_b").where("repo = repo_b").select("text_a", "text_b", "title", "body", "title_b", "body_b").mapInPandas(_verify, PAIR)


# decision -----------------------------------------------------------------------------------------------------------


def _decided(state: DataFrame, joined: DataFrame) -> DataFrame:
    """One round: reject what has an accepted record before it, accept what has nothing undecided before it.

    ``state``: rec_id, repo, at, print, text, status, known; only records with ``known`` (all links of their text are in
    ``joined``) can be accepted.
    """
    earliest = lambda what: F.min(F.when(F.col("status") == what, F.col("at")))
    by_print = state.where("print is not null").groupBy("repo", "print").agg(earliest("accepted").alias("pa"), earliest("open").alias("po"))
    by_text = state.groupBy("text").agg(earliest("accepted").alias("a"), earliest("open").alias("o"))
    around = joined.join(by_text.withColumnRenamed("text", "other"), "other").groupBy("text").agg(F.min("a").alias("ta"), F.min("o").alias("to"))
    seen = state.join(by_print, ["repo", "print"], "left").join(around, "text", "left")
    accepted_before = F.coalesce(F.least("pa", "ta") < F.col("at"), F.lit(False))
    open_before = F.coalesce(F.least("po", "to") < F.col("at"), F.lit(False))
    status = F.when(F.col("status") != "open", F.col("status")).when(accepted_before, F.lit("repeat")).when(F.col("known") & ~open_before, F.lit("accepted")).otherwise(F.lit("open"))
    return seen.select("rec_id", "repo", "at", "print", "text", status.alias("status"), "known")


def _settled(state: DataFrame, joined: DataFrame) -> DataFrame:
    """Rounds until nothing more can be decided. There are no more of them than batches of one repository."""
    left = state.where("status = 'open'").count()
    while left:
        state = staged(_decided(state, joined))
        before, left = left, state.where("status = 'open'").count()
        if left == before:
            break
    return state


class SegmentIndex:
    """Everything accepted so far, as tables in a folder, to check new batches without reading all of it again.

    ``records`` holds the accepted records, ``entries`` the segments and substrings of their titles, ``seen`` the ids of all
    records checked. All are partitioned by a bucket of the repository, so a delivery reads the buckets of its
    repositories only. A delivery is any number of batches, all later than those before it. It counts once its number is
    in ``commits``, which is written last: a delivery that failed is checked again as if nothing had happened.
    """

    TABLES = {
        "records": "repo long, text long, at timestamp, print string, title string, body array<string>",
        "entries": "repo long, own boolean, key long, text long, n int, even long, odd long",
        "seen": "repo long, text long",
    }

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _next(self) -> int:
        """The number of the next delivery."""
        try:
            return self.spark.read.schema("delivery int").parquet(f"{self.folder}/commits").agg(F.max("delivery").alias("n")).first().n + 1
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    def _bucket(self) -> Column:
        return F.pmod("repo", F.lit(self.buckets)).cast("int")

    def _stored(self, name: str, number: int, buckets: list[int]) -> DataFrame:
        """The stored rows of some buckets, without those of a delivery that was not committed."""
        ddl = self.TABLES[name]
        if not number:
            return self.spark.createDataFrame([], ddl)
        held = self.spark.read.schema(f"{ddl}, delivery int, bucket int").parquet(f"{self.folder}/{name}")
        return held.where((F.col("delivery") < number) & F.col("bucket").isin(buckets)).drop("delivery", "bucket")

    def _store(self, df: DataFrame, name: str, number: int) -> None:
        columns = [c.split(" ")[0] for c in self.TABLES[name].split(", ")]
        rows = df.select(*columns).withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{name}/delivery={number}")

    def check(self, delivery: DataFrame) -> DataFrame:
        """Check the records (as ``records`` gives them) of new batches and store those that are accepted.

        Returns id_a < id_b: each record that repeats an accepted one of an earlier batch of its repository, with that
        one; of several accepted ones with one fingerprint or one text, the earliest, then the smallest id. Batches of one
        time don't see each other. Records checked before are left out.
        """
        number = self._next()
        delivery = staged(delivery.withColumn("at", F.col("at").cast("timestamp")))
        buckets = [r.bucket for r in delivery.select(self._bucket().alias("bucket")).distinct().collect()]  # at most self.buckets
        stored = {name: self._stored(name, number, buckets) for name in self.TABLES}
        new = delivery.join(stored["seen"].select(F.col("text").alias("rec_id")), "rec_id", "left_anti") if number else delivery
        keyed = staged(new.withColumns({"k1": F.xxhash64("repo", "title", "body"), "k2": F.xxhash64(F.lit(1), "repo", "body", "title")}))
        ids = keyed.groupBy("k1", "k2").agg(F.min("rec_id").alias("text"), F.min("at").alias("since"))
        named = staged(keyed.join(ids, ["k1", "k2"]))
        wordings = named.where("rec_id = text").select("repo", "text", "title", "body")
        texts = Indexed(wordings, staged(entries(wordings), "own"))
        state = named.select("rec_id", "repo", "at", "print", "text")

        old = stored["records"]
        if number:
            found = texts.links(Indexed(old, stored["entries"])).select(F.col("text_a").alias("text"), F.col("text_b").alias("first"))
            by_print = old.where("print is not null").groupBy("repo", "print").agg(F.min(F.struct("at", "text"))["text"].alias("first"))
            against_old = staged(state.join(found, "text").select("rec_id", "text", "first").unionByName(state.join(by_print, ["repo", "print"]).select("rec_id", "text", "first")))
        else:
            against_old = self.spark.createDataFrame([], "rec_id long, text long, first long")

        repeated = against_old.select("rec_id").distinct().withColumn("hit", F.lit("repeat"))
        state = staged(state.join(repeated, "rec_id", "left").select(*state.columns, F.coalesce("hit", F.lit("open")).alias("status"), F.lit(False).alias("known")))
        state, told = self._decide(state, named, texts)
        hits = against_old.select("rec_id", "first").unionByName(told).distinct()

        fresh = state.where("status = 'accepted'").select("rec_id")
        kept = staged(named.drop("text").join(fresh, "rec_id").withColumnRenamed("rec_id", "text"))
        self._store(kept, "records", number)
        whose = named.join(fresh, "rec_id").groupBy("repo", "text").agg(F.min("rec_id").alias("rec_id"))  # those of one text are of one time
        self._store(texts.entries.join(whose, "text").drop("text").withColumnRenamed("rec_id", "text"), "entries", number)
        self._store(keyed.select("repo", F.col("rec_id").alias("text")), "seen", number)
        self.spark.createDataFrame([(number,)], "delivery int").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return hits.select(F.least("rec_id", "first").alias("id_a"), F.greatest("rec_id", "first").alias("id_b"))

    def _decide(self, state: DataFrame, named: DataFrame, texts: Indexed) -> tuple[DataFrame, DataFrame]:
        """The status of every record of a delivery, and the repeats (rec_id, first) of others of the delivery."""
        both = lambda df: df.unionByName(df.select(F.col("text_b").alias("text_a"), F.col("text_a").alias("text_b")))
        joined = lambda pairs: pairs.select(F.col("text_a").alias("text"), F.col("text_b").alias("other")).unionByName(state.select("text", F.col("text").alias("other"))).distinct()

        # the earliest of each large group of texts with one title segment and one smallest hash of three words
        triples = lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        smallest = F.array_min(F.flatten(F.transform("body", lambda s: let(F.split(s, " "), triples))))
        shared = texts.segments.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= GROUPED).select("key")
        dense = staged(texts.segments.join(shared, "key", "left_semi").select("key", "text"))
        marks = named.where("rec_id = text").join(dense.select("text").distinct(), "text", "left_semi").join(state.where("status = 'open'").select("text").distinct(), "text", "left_semi").select("text", "since", smallest.alias("mark"))
        groups = dense.join(marks, "text").groupBy("key", "mark").agg(F.count("*").alias("n"), F.min(F.struct("since", "text"))["text"].alias("leader"))
        leaders = staged(groups.where(F.col("n") >= GROUPED).select(F.col("leader").alias("text")).distinct())
        known = self.spark.createDataFrame([], PAIR)
        if not leaders.isEmpty():
            known = staged(both(texts.only(leaders).links(texts)).distinct())
            state = state.join(leaders.withColumn("lead", F.lit(True)), "text", "left").select("rec_id", "repo", "at", "print", "text", "status", F.coalesce("lead", F.lit(False)).alias("known"))
            state = _settled(staged(state), staged(joined(known)))

        # all pairs of what is left
        done = staged(state.groupBy("text").agg(F.bool_or((F.col("status") == "open") & ~F.col("known")).alias("left")).where("not left").select("text"))
        left_out = not done.isEmpty()
        inside = staged(known.unionByName((texts.without(done) if left_out else texts).links_inside()))
        state = _settled(state.withColumn("known", F.lit(True)), staged(joined(inside)))

        # what was left out of the search: its links with what is accepted
        accepted = state.where("status = 'accepted'")
        if left_out:
            refused = state.groupBy("text").agg(F.bool_and(F.col("status") == "repeat").alias("all")).where("all").select("text")
            inside = inside.unionByName(texts.only(done.join(leaders, "text", "left_anti")).links(texts.without(refused.unionByName(leaders))))
        first = F.min(F.struct("at", "rec_id")).alias("first")
        repeat = state.where("status = 'repeat'")
        by_print = accepted.where("print is not null").groupBy("repo", "print").agg(first)
        by_text = accepted.groupBy("text").agg(first).withColumnRenamed("text", "other")
        same_print = repeat.join(by_print, ["repo", "print"])
        same_text = repeat.join(joined(inside), "text").join(by_text, "other")
        told = same_print.select("rec_id", "at", "first").unionByName(same_text.select("rec_id", "at", "first")).where("first.at < at")
        return state, staged(told.select("rec_id", F.col("first.rec_id").alias("first")).distinct())


def repeats(scans: DataFrame, findings: DataFrame, deliveries: int = 2) -> DataFrame:
    """id_a < id_b: each record that repeats an accepted one of an earlier batch of its repository, with that one.

    All batches go through a new ``SegmentIndex`` in the order of time, in as many ``deliveries`` of about the same number
    of records; the result doesn't depend on how they are cut. A record repeats another if both have the same fingerprint
    or say the same (see the module). A record that repeats nothing accepted is accepted. Records without batch, time or
    repository are left out. Empty input gives no rows; extra columns are ignored.
    """
    spark = scans.sparkSession
    rows = staged(records(scans, findings).withColumn("at", F.col("at").cast("timestamp")))
    shares = [i / deliveries for i in range(1, deliveries)]
    cuts = sorted(set(rows.agg(F.percentile_approx("at", shares, 1000).alias("cuts")).first().cuts or [])) if shares else []
    index = SegmentIndex(spark, f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}")
    found: DataFrame | None = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows.where((F.lit(True) if low is None else F.col("at") > F.lit(low)) & (F.lit(True) if high is None else F.col("at") <= F.lit(high)))
        told = index.check(part)
        found = told if found is None else found.unionByName(told)
    return found
