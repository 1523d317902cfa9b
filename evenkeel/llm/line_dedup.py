"""Near-duplicate lines by an exact set-similarity join; the later line of each matching pair is removed.

DataFrame operations only. A rule says what a line's tokens are. WORDS, which report() and deduplicate()
use: its distinct runs of letters, digits and characters beyond ASCII, lower-cased. SHINGLES, the default
of mark(): its distinct shingles of five runs between spaces (tabs and the like count as spaces),
lower-cased, or all of them as one token if they are fewer; under it lines of 5 to 38 words with one
inner word changed do not match, nor do lines under five words that differ in punctuation.

Lines match when |common tokens| / |all tokens| is SIMILARITY per cent or more. Lines stand in the order
of doc_id (null last), the two 64-bit hashes of the whole text, line number. A line goes when an earlier
line matches it, whether or not that line stays; so of equal lines the first can stay. A line without
tokens is never removed.

1. Equal lines are one class, found by 128 bits of hash and placed at the first of them. Sorted by place
   they are numbered, so that a class's number also is its place in the order.
2. Each class is cut into tokens (56-bit hashes) once; the sets are a table of their own. Texts are
   shuffled once for this and once for the result.
3. Tokens are ordered by rarity: four levels for each doubling of how often a token's bucket occurs, of
   BUCKETS buckets, a table of fixed size; within a level by hash. A frequent token has the high count of
   its bucket whatever else is in it, so boilerplate sorts last.
4. Of two lines that match, the one of more tokens (n) has one of its n - ceil(0.75 n) + 1 rarest tokens in
   common with the m - ceil(6/7 m) + 1 rarest of the other (prefix filter). These prefixes are a table too.
5. Each class first meets, for each of its SETTLING rarest tokens, the first class of each size that has
   it, a number of pairs linear in the classes; those that match are settled, which in a large group of
   copies leaves few.
6. Then prefixes are joined by token, a share of the tokens at a time, for pairs whose later class is not
   settled. Pairs pass three filters before they are made, none of which loses a match: the length filter,
   the positional filter at the pair's first common token, and the bits in which the parities of the two
   token sets differ, which are no more than the tokens that only one has. They are verified by their
   whole token sets.

Defined cases: null text stays null, empty text stays; rows that repeat doc_id and text are one
document and get one verdict; rows that repeat doc_id (or have none) with other texts are documents of
their own; texts of any length are cut whole; an empty table gives no rows; further columns pass through.
A document all of whose lines with tokens are removed is left with its blank lines; deduplicate() drops it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import discard, fresh_name, materialise

SIMILARITY = 75
SHINGLE = 5
BUCKETS = 1 << 17
CHUNK = 1 << 12  # buckets in one row that comes to the driver
PER_DOUBLING, TOP_LEVEL = 4, 126
SETTLING = 8
TURNS = 4
SMALL_ROWS = 1 << 20  # settled classes that are broadcast (8 bytes each); more are joined by a shuffle
_HASH_BITS = 56
_FOLD = 64  # tokens up to which one word of parities tells sets apart
#: A document: whether it has no doc_id, the doc_id, two hashes of its text.
DOCUMENT = ["no_id", "d", "t1", "t2"]
#: Every ASCII character but letters and digits, one by one, which Java tests faster than ranges. Texts are lower-cased.
_BETWEEN = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not (chr(c).isdigit() or chr(c).islower())) + "]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(line: Column) -> Column:
    plain = F.lower(line)
    plain = F.when(plain.rlike(r"[\t\r\f\x0B]"), F.translate(plain, "\t\r\f\x0b", "    ")).otherwise(plain)
    return F.array_remove(F.split(plain, " "), "")


def shingle_hashes(line: Column) -> Column:
    """The distinct five-word tokens of a line with words, as hashes."""

    def shingled(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(SHINGLE))))
        return F.when(F.size(h) >= SHINGLE, F.array_distinct(each)).otherwise(F.array(F.xxhash64(h)))

    return F.transform(let(F.transform(words_of(line), lambda w: F.xxhash64(w)), shingled), lambda t: F.shiftrightunsigned(t, 64 - _HASH_BITS))


def word_hashes(line: Column) -> Column:
    """The distinct words (letters, digits, characters beyond ASCII) of a line, as hashes."""
    words = F.array_remove(F.split(F.lower(line), _BETWEEN), "")
    return F.array_distinct(F.transform(words, lambda w: F.shiftrightunsigned(F.xxhash64(w), 64 - _HASH_BITS)))


@dataclass(frozen=True)
class Rule:
    """What a line's tokens are, and the pattern of a character that gives a line any."""

    hashes: Callable[[Column], Column]
    some: str


WORDS = Rule(word_hashes, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
SHINGLES = Rule(shingle_hashes, r"[^ \t\r\f\x0B]")


def document_key() -> list[Column]:
    return [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2")]


def numbered_lines(docs: DataFrame, rule: Rule) -> DataFrame:
    """no_id, d, t1, t2, at, o: the first place of each different line with tokens, and its number in the order of places."""
    rows = docs.where("text is not null").select(*document_key(), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = rows.where(F.col("line").rlike(rule.some)).select(F.xxhash64("line").alias("k"), F.xxhash64(F.lit(7), "line").alias("k2"), F.struct(*DOCUMENT, "at").alias("p"))
    first = materialise(rows.groupBy("k", "k2").agg(F.min("p").alias("p")).select("p.*"), "lines")
    placed = first.repartitionByRange(*DOCUMENT).sortWithinPartitions(*DOCUMENT, "at")
    out = materialise(placed.select(*DOCUMENT, "at", F.monotonically_increasing_id().alias("o")), "numbered")
    discard(first)
    return out


def token_sets(docs: DataFrame, lines: DataFrame, rule: Rule) -> DataFrame:
    """o, tokens, b0, b1: the token set of each numbered line, and its parities."""
    wanted = lines.groupBy(*DOCUMENT).agg(F.collect_list(F.struct("at", "o")).alias("wanted"))
    # Rows that repeat a document have the same lines.
    own = docs.where("text is not null").select(*document_key(), "text").groupBy(*DOCUMENT).agg(F.first("text").alias("text"))
    each = let(F.split("text", "\n"), lambda lines: F.transform("wanted", lambda e: F.struct(e["o"].alias("o"), F.get(lines, e["at"]).alias("line"))))
    rows = own.join(wanted, DOCUMENT).select(F.explode(each).alias("e")).select("e.o", rule.hashes(F.col("e.line")).alias("tokens"))
    return materialise(rows.select("o", "tokens", *parities(F.col("tokens"))), "sets", "zstd")


def rarity_levels(sets: DataFrame) -> Column:
    """A literal array of BUCKETS levels (shifted over a hash), one for each bucket of token hashes. Only these come to the driver, whatever the input."""
    bucket = F.col("token").bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    counts = sets.select(F.explode("tokens").alias("token")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    level = F.least(F.floor(PER_DOUBLING * F.log2("n")), F.lit(TOP_LEVEL)).cast("int")
    levels = [0] * BUCKETS
    for _, found in counts.groupBy(F.floor(F.col("bucket") / CHUNK)).agg(F.collect_list(F.struct("bucket", level.alias("level")))).toLocalIterator():
        for at, x in found:
            levels[at] = x << _HASH_BITS
    return F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>")


def parities(tokens: Column) -> list[Column]:
    """b0, b1: whether an odd number of tokens falls on each of 128 bits; of at most _FOLD tokens on each of 64, b1 being 0.

    Two sets differ in at least as many tokens as bits. b0 XOR b1 is the word of 64 for any set.
    """

    def word(half: int | None) -> Column:
        def flip(bits: Column, token: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), token.bitwiseAND(F.lit(63)).cast("int"))
            return bits.bitwiseXOR(bit) if half is None else F.when(token.bitwiseAND(F.lit(64)) == 64 * half, bits.bitwiseXOR(bit)).otherwise(bits)

        return F.aggregate(tokens, F.lit(0).cast("long"), flip)

    few = F.size(tokens) <= _FOLD
    return [F.when(few, word(None)).otherwise(word(0)).alias("b0"), F.when(few, F.lit(0).cast("long")).otherwise(word(1)).alias("b1")]


def prefix_rows(sets: DataFrame, levels: Column) -> DataFrame:
    """token, o, n, pos, b0, b1: the rarest tokens of each set, with its size and parities."""
    rank = lambda t: F.get(levels, t.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")) + t
    sig = sets.select("o", "b0", "b1", F.size("tokens").alias("n"), F.sort_array(F.transform("tokens", rank)).alias("sig"))
    rarest = F.slice("sig", F.lit(1), F.col("n") - F.ceil(F.col("n") * SIMILARITY / 100).cast("int") + 1)
    return materialise(sig.select("o", "n", "b0", "b1", F.posexplode(rarest).alias("pos", "token")), "prefixes")


def may_match(a: Callable[[str], Column], b: Callable[[str], Column], first: bool) -> Column:
    """Length, positional and parity filters for two rows of one token; first: only as the pair's first common token."""
    n, m, pos, pos2 = a("n"), b("n"), a("pos"), b("pos")
    common = F.ceil((n + m) * SIMILARITY / (100 + SIMILARITY))
    before = F.lit(0) if first else F.least(pos, pos2)
    d0, d1 = a("b0").bitwiseXOR(b("b0")), a("b1").bitwiseXOR(b("b1"))
    apart = F.when(F.least(n, m) > _FOLD, F.bit_count(d0) + F.bit_count(d1)).otherwise(F.bit_count(d0.bitwiseXOR(d1)))
    sized = F.least(n, m) * 100 >= F.greatest(n, m) * SIMILARITY
    return sized & (1 + F.least(n - pos - 1, m - pos2 - 1) + before >= common) & (apart <= n + m - 2 * common)


def sides() -> tuple[Callable[[str], Column], Callable[[str], Column]]:
    return (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))


def by_turns(rows: DataFrame, pairs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs of all tokens, a share of the tokens at a time, so that only that share is shuffled at once."""
    return reduce(DataFrame.union, [materialise(pairs(rows.where(F.col("token").bitwiseAND(F.lit(TURNS - 1)) == turn)), "pairs") for turn in range(TURNS)])


def first_candidates(rows: DataFrame) -> DataFrame:
    """Pairs (o, o2) of a class and the first class, of each size, that has one of its rarest tokens."""
    few = rows.where(F.col("pos") < SETTLING)
    first = few.groupBy("token", "n").agg(F.min(F.struct("o", "pos", "b0", "b1")).alias("v")).select("token", "n", "v.*")
    a, b = sides()
    pairs = few.alias("x").join(first.alias("y"), (a("token") == b("token")) & (b("o") < a("o")) & may_match(a, b, False))
    return pairs.select("x.o", b("o").alias("o2"))


def all_candidates(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """Pairs (o, o2 before it) of classes of which the later one is not settled (o_)."""
    a, b = sides()
    sized = (a("n") > b("n")) | ((a("n") == b("n")) & (a("o") > b("o")))
    open_ = F.when(a("o") > b("o"), ~a("settled")).otherwise(~b("settled"))
    told = rows.join(settled, F.col("o") == F.col("o_"), "left").select("token", "o", "n", "pos", "b0", "b1", F.col("o_").isNotNull().alias("settled"))
    index = told.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * (2 * SIMILARITY) / (100 + SIMILARITY)))
    pairs = told.alias("x").join(index.alias("y"), (a("token") == b("token")) & sized & open_ & may_match(a, b, True))
    return pairs.select(F.greatest("x.o", "y.o").alias("o"), F.least("x.o", "y.o").alias("o2"))


def matched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The classes (o) of pairs whose token sets match."""
    parts, pairs = pairs, materialise(pairs.distinct(), "pairs")
    discard(parts)
    names = pairs.select("o").union(pairs.select("o2")).distinct()
    own = materialise(sets.select("o", "tokens").join(names, "o", "left_semi"), "candidates", "zstd")
    other = own.select(F.col("o").alias("o2"), F.col("tokens").alias("tokens2"))
    common = F.size(F.array_intersect("tokens", "tokens2"))
    both = pairs.join(own, "o").join(other, "o2")
    out = materialise(both.where(common * 100 >= (F.size("tokens") + F.size("tokens2") - common) * SIMILARITY).select("o").distinct(), "gone")
    discard(own)
    discard(pairs)
    return out


def removed_lines(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The first places of all different lines (no_id, d, t1, t2, at, o), and of those the ones (o) that match an earlier line."""
    lines = numbered_lines(docs, rule)
    sets = token_sets(docs, lines, rule)
    rows = prefix_rows(sets, rarity_levels(sets))
    gone = matched(by_turns(rows, first_candidates), sets)
    settled = gone.select(F.col("o").alias("o_"))
    settled = F.broadcast(settled) if settled.count() <= SMALL_ROWS else settled
    gone = gone.union(matched(by_turns(rows, lambda share: all_candidates(share, settled)), sets))
    discard(rows)
    discard(sets)
    return lines, gone


def kept_numbers(docs: DataFrame, rule: Rule) -> DataFrame:
    """no_id, d, t1, t2, kept: for each document with any, the numbers of its lines with tokens that stay."""
    lines, gone = removed_lines(docs, rule)
    return lines.join(gone, "o", "left_anti").groupBy(*DOCUMENT).agg(F.collect_list("at").alias("kept"))


def mark(docs: DataFrame, name: str = "line_dedup", rule: Rule = SHINGLES) -> DataFrame:
    """docs with a struct: text (without the removed lines), n_lines, n_removed, emptied (no line with tokens is left of some)."""
    name = fresh_name(docs.columns, name)
    columns = docs.columns
    kept = kept_numbers(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")), rule)
    keys = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), *document_key())
    rows = keys.join(kept, DOCUMENT, "left").select("row", "kept", F.split("row.text", "\n").alias("parts"))
    blank = F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: ~F.get(F.col("parts"), i).rlike(rule.some))
    rows = rows.select("row", "parts", "kept", F.when(F.col("parts").isNotNull(), blank).alias("blank"))
    stay = F.array_sort(F.concat(F.coalesce("kept", F.expr("cast(array() as array<int>)")), "blank"))
    rows = rows.select("row", "parts", "kept", "blank", stay.alias("stay"))
    text = F.array_join(F.transform("stay", lambda i: F.get(F.col("parts"), i)), "\n")
    n = F.when(F.col("parts").isNull(), 0).otherwise(F.size("parts"))
    left = F.when(F.col("parts").isNull(), 0).otherwise(F.size("stay"))
    emptied = F.col("parts").isNotNull() & F.col("kept").isNull() & (F.size("blank") < F.size("parts"))
    out = F.struct(text.alias("text"), n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_removed"), emptied.alias("emptied"))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in columns), out.alias(name))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with the texts that remain (n_chars, where there is one, counts anew); documents left without a line go."""
    marked = mark(docs, rule=WORDS)
    verdict = F.col(f"`{marked.columns[-1]}`")
    new = {"text": verdict["text"], "n_chars": F.when(verdict["n_removed"] > 0, F.length(verdict["text"]).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return marked.where(~verdict["emptied"]).select(*(new[c].alias(c) if new.get(c) is not None else F.col(f"`{c}`") for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, and the SHA-256 of the text that stays (null text: null)."""
    marked = mark(docs.select("doc_id", "text"), rule=WORDS)
    verdict = F.col(f"`{marked.columns[-1]}`")
    return marked.select("doc_id", verdict["n_lines"].alias("n_lines"), verdict["n_removed"].alias("n_removed"), F.sha2(verdict["text"], 256).alias("text_sha256"))


#: For tables in which a doc_id is that of one document.
REPORT_SQL = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS place, unnest(parts) AS line FROM d WHERE text IS NOT NULL),
c AS (SELECT line, min(struct_pack(d := doc_id, k := place)) AS p, list_distinct(regexp_extract_all(lower(line), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS g FROM l GROUP BY line),
s AS (SELECT line, p, g, len(g) AS n, row_number() OVER (ORDER BY p) AS o FROM c WHERE len(g) > 0),
t AS (SELECT o, n, unnest(g) AS token FROM s), f AS (SELECT token, count(*) AS df FROM t GROUP BY token),
r AS (SELECT o, n, token, row_number() OVER (PARTITION BY o ORDER BY df, token) AS rank FROM t JOIN f USING (token)),
x AS (SELECT o, n, token FROM r WHERE rank <= n - ceil(n * {SIMILARITY} / 100.0) + 1),
q AS (SELECT DISTINCT a.o AS late, b.o AS early FROM x a JOIN x b ON a.token = b.token AND b.o < a.o AND 100 * least(a.n, b.n) >= {SIMILARITY} * greatest(a.n, b.n)),
m AS (SELECT late, len(list_intersect(a.g, b.g)) AS k, a.n + b.n AS total FROM q JOIN s a ON a.o = late JOIN s b ON b.o = early),
z AS (SELECT DISTINCT late FROM m WHERE 100 * k >= {SIMILARITY} * (total - k)),
stay AS (SELECT l.doc_id, l.place, l.line FROM l JOIN c USING (line) LEFT JOIN s USING (line) LEFT JOIN z ON z.late = s.o
    WHERE len(c.g) = 0 OR (z.late IS NULL AND c.p = struct_pack(d := l.doc_id, k := l.place))),
k AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY place) AS text FROM stay GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(parts) END AS n_lines, CASE WHEN d.text IS NULL THEN 0 ELSE len(parts) - coalesce(k.n, 0) END AS n_removed,
    CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.text, '')) END AS text_sha256 FROM d LEFT JOIN k USING (doc_id)"""
