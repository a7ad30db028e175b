"""Lineage: which earlier launch a launch copies, by name, ticker and logo, and what kind of copy it is.

Roles on the driver's tables: an event is a launch, a part gives its name and ticker, the user its logo. Launches meet in groups (the same ticker and an
agreeing name, the same logo, both), and each asks only for the earliest launch of its groups in the window, so no pairs of launches are made: a group
is cut by days, and one row for each day tells where the next launch is. Launches without a time have no lineage but are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators import trailing
from loomwright.operators.earliest import earliest
from loomwright.operators.trailing import SECOND, micros
from loomwright.operators.trailing_counts import counts_before
from loomwright.operators.whole_groups import look_back
from loomwright.plans.registry import Pack
from loomwright.plans.upkeep import close_pairs
from loomwright.sources.scratch import written

pack = Pack()
QUERIES, ORACLE_SQL = pack.queries, pack.sql

#: Seconds that an original is older at least, days that are looked back, hours in which namesakes must be silent for a name to count as only referred to.
MIN_GAP, WINDOW_DAYS, QUIET_HOURS = 300, 30, 24
LATE_RANK, LATE_HOURS, EARLY_RANK, EARLY_HOURS = 11, 24, 3, 6
#: Words that don't distinguish a name, words that are dropped from it, letters of a distinctive word, and when spellings are close.
EVERYDAY = ("small", "large", "red", "blue", "old", "new", "hot", "cold", "ring", "gear")
FILLER, WORD_LETTERS, FUZZY, FUZZY_LETTERS = ("old", "new"), 4, 0.85, 6

_DAY = 86_400
#: More than any two ids are apart.
_IDS = 1 << 64


def compact_of(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]", "")


def core_of(name: Column) -> Column:
    """The name without filler words, unless it has no others, and without spaces."""
    words = F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}]+"), 0)
    kept = F.filter(words, lambda w: ~w.isin(*FILLER))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), "")


def distinctive(name: Column) -> Column:
    """Words by which names agree."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{N}]+"), 0))
    return F.filter(words, lambda w: (F.length(w) >= WORD_LETTERS) & w.rlike(r"^\p{L}+$") & ~w.isin(*EVERYDAY, *FILLER))


def agreement_keys(names: DataFrame) -> DataFrame:
    """(ticker, name, key): names of one ticker agree if they have a key in common: the compact name, the core, a distinctive word, or a pair of close spellings.

    ``names`` has one row for each distinct ticker and name.
    """
    named = names.select("ticker", "name", compact_of(F.col("name")).alias("compact"), core_of(F.col("name")).alias("core"), distinctive(F.col("name")).alias("words"))
    keys = F.concat(F.array(F.concat(F.lit("c:"), "compact"), F.concat(F.lit("k:"), "core")), F.transform("words", lambda w: F.concat(F.lit("w:"), w)))
    plain = named.select("ticker", "name", F.explode(keys).alias("key"))
    cores = named.filter(F.length("core") >= FUZZY_LETTERS).select(F.col("ticker").alias("p_type"), F.col("core").alias("name")).distinct()
    close = close_pairs(cores, FUZZY).select(F.col("p_type").alias("ticker"), F.concat(F.lit("f:"), "a", F.lit("|"), "b").alias("key"), F.explode(F.array("a", "b")).alias("core"))
    return plain.unionByName(named.join(close, ["ticker", "core"]).select("ticker", "name", "key")).distinct()


#: Keys of a name up to which the union of its groups is counted over all their intersections.
MOST_KEYS = 5
#: Launches up to which a group is ordered whole by one task, and logos beyond that up to which they are broadcast.
CROWD, MOST_CROWDED = 1_000_000, 100_000


def telling_keys(keys: DataFrame) -> DataFrame:
    """``keys`` (ticker, name, key) without those that add nothing: a key all of whose names have another one in common."""
    sizes = keys.groupBy("ticker", "key").agg(F.count("*").alias("n"))
    other = keys.select("ticker", "name", F.col("key").alias("wider"))
    both = keys.join(other, ["ticker", "name"]).filter("key != wider").groupBy("ticker", "key", "wider").agg(F.count("*").alias("both"))
    both = both.join(sizes, ["ticker", "key"]).join(sizes.select("ticker", F.col("key").alias("wider"), F.col("n").alias("m")), ["ticker", "wider"])
    covered = both.filter("both = n AND (m > n OR wider < key)").select("ticker", "key").distinct()
    return keys.join(covered, ["ticker", "key"], "left_anti")


def subsets(keys: Column) -> Column:
    """All subsets of a sorted array but the empty one, as (group, size)."""
    masks = F.sequence(F.lit(1), (F.pow(F.lit(2.0), F.size(keys)) - 1).cast("int"))
    chosen = lambda m: F.filter(keys, lambda _, k: F.pmod(F.floor(m / F.pow(F.lit(2.0), k)), F.lit(2)) == 1)
    return F.when(F.size(keys) > 0, F.transform(masks, lambda m: F.struct(F.concat(F.lit("s:"), F.array_join(chosen(m), "\x1f")).alias("grp"), F.size(chosen(m)).alias("size"))))


def with_crowds(rows: DataFrame) -> tuple[DataFrame, bool]:
    """``rows`` with ``crowded``: whether a row's logo has more than ``CROWD`` rows; and whether there are any such."""
    crowds = written(rows.filter("logo IS NOT NULL").groupBy("logo").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select("logo", F.lit(True).alias("many")), "crowded-logos")
    n = crowds.count()
    if n == 0:
        return rows.withColumn("crowded", F.lit(False)), False
    crowds = F.broadcast(crowds) if n <= MOST_CROWDED else crowds
    return rows.join(crowds, "logo", "left").withColumn("crowded", F.coalesce("many", F.lit(False))).drop("many"), True


def names_with_keys(keys: DataFrame, sizes: DataFrame) -> DataFrame:
    """(ticker, name, keys, crowds, crowd): the telling keys of each name as a sorted array, which of them more than ``CROWD`` launches have, and whether the ticker has as many; ``sizes`` (ticker, name, n) are the launches of names."""
    single = telling_keys(keys).join(sizes, ["ticker", "name"])
    totals = single.groupBy("ticker", "key").agg((F.sum("n") > CROWD).alias("crowd"))
    named = single.join(totals, ["ticker", "key"]).groupBy("ticker", "name").agg(F.array_sort(F.collect_list(F.struct("key", "crowd"))).alias("k"))  # keys of one name
    tickers = sizes.groupBy("ticker").agg((F.sum("n") > CROWD).alias("crowd"))
    return named.join(tickers, "ticker").select("ticker", "name", F.col("k.key").alias("keys"), F.col("k.crowd").alias("crowds"), "crowd")


def name_groups(named: DataFrame) -> DataFrame:
    """(ticker, name, keys, groups) from ``names_with_keys``: the groups that a name is in, as (grp, kind, sign, crowd, stem, logo_kind, logo_sign).

    Kind t is the ticker, n one key, s several keys at once. ``stem`` begins the name of the group's part that has a logo too, of kind b for the ticker, else x. Signs are those by which the ticker less the
    union of what a launch shares is counted. A name of more than ``MOST_KEYS`` keys has groups without a sign for its keys, and none of several.
    """
    in_ticker = lambda grp: F.concat(F.col("ticker"), F.lit("|"), grp)
    group = lambda grp, kind, sign, crowd, stem, logo_kind, logo_sign: F.struct(
        grp.alias("grp"), kind.alias("kind"), sign.cast("int").alias("sign"), crowd.alias("crowd"), stem.alias("stem"), logo_kind.alias("logo_kind"), logo_sign.cast("int").alias("logo_sign"))
    few = F.size("keys") <= MOST_KEYS
    ticker = group(F.concat(F.lit("t:"), "ticker"), F.lit("t"), F.lit(1), F.col("crowd"), in_ticker(F.lit("s:")), F.lit("b"), F.when(few, -1).otherwise(0))
    # An intersection is crowded if all its keys are.
    known = F.map_from_arrays("keys", "crowds")
    crowded = lambda grp: F.forall(F.split(F.substring(grp, 3, 1 << 30), "\x1f"), lambda k: F.coalesce(F.element_at(known, k), F.lit(True)))
    sign = lambda x: F.when(x["size"] % 2 == 1, -1).otherwise(1)
    met = F.transform(subsets(F.col("keys")), lambda x: group(
        in_ticker(x["grp"]), F.when(x["size"] == 1, "n").otherwise("s"), sign(x), crowded(x["grp"]), F.concat(in_ticker(x["grp"]), F.lit("\x1f")), F.lit("x"), -sign(x)))
    alone = F.transform(F.arrays_zip("keys", "crowds"), lambda z: group(in_ticker(F.concat(F.lit("s:"), z["keys"])), F.lit("n"), F.lit(0), z["crowds"], F.lit(None).cast("string"), F.lit("x"), F.lit(0)))
    return named.select("ticker", "name", "keys", F.concat(F.array(ticker), F.when(few, met).otherwise(alone)).alias("groups"))


def long_names(timed: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and questions for ``counts_before`` of launches whose names have more than ``MOST_KEYS`` telling keys, which are rare: counted over the distinct names that agree with them."""
    many = named.filter(F.size("keys") > MOST_KEYS)
    own = lambda ks: F.array_compact(F.concat(ks, F.array("logo")))
    in_ticker = lambda grp: F.concat(F.col("ticker"), F.lit("|"), grp)
    # Names that agree, in which one has many keys: few, as such names are.
    telling = named.select("ticker", "name", F.explode("keys").alias("key"))
    crowd = telling.join(many.select("ticker", F.col("name").alias("long")).join(telling.withColumnRenamed("name", "long"), ["ticker", "long"]), ["ticker", "key"])
    pairs = written(crowd.groupBy("ticker", "long", "name").agg(F.array_sort(F.collect_list("key")).alias("shared")), "long-names")
    # As members they are in the intersections of what they share with names of few keys.
    short = pairs.join(named.filter(F.size("keys") <= MOST_KEYS).select("ticker", "name"), ["ticker", "name"])
    met = short.select("ticker", F.col("long").alias("name"), "shared").distinct()
    long_rows = timed.join(many.select("ticker", "name"), ["ticker", "name"], "left_semi")
    shared = F.coalesce("shared", F.array().cast("array<string>"))
    joined = long_rows.join(met, ["ticker", "name"], "left").select("id", "at", "ticker", F.explode(subsets(own(shared))).alias("s")).select("id", "at", in_ticker(F.col("s.grp")).alias("grp")).distinct()
    # As questions they go through the names that agree with them, one by one, and take those of their logo once.
    by_name = timed.select("at", F.explode(F.array_compact(F.array(in_ticker(F.concat(F.lit("N:"), "name")), in_ticker(F.concat(F.lit("N:"), "name", F.lit("|"), "logo"))))).alias("grp"))
    asked = long_rows.select("id", "at", "ticker", F.col("name").alias("long"), "logo").join(pairs.select("ticker", "long", "name"), ["ticker", "long"])
    asked = asked.select("id", "at", F.inline(F.array(F.struct(in_ticker(F.concat(F.lit("N:"), "name")).alias("grp"), F.lit(-1).alias("sign")), F.struct(in_ticker(F.concat(F.lit("N:"), "name", F.lit("|"), "logo")).alias("grp"), F.lit(1).alias("sign")))))
    by_logo = long_rows.filter("logo IS NOT NULL").select("id", "at", in_ticker(F.concat(F.lit("s:"), "logo")).alias("grp"), F.lit(-1).alias("sign"))
    return joined.select("grp", "at").unionByName(by_name.select("grp", "at")), asked.unionByName(by_logo)


def standing(rows: DataFrame, keys: DataFrame, sizes: DataFrame) -> DataFrame:
    """What the groups of each launch tell: id; the earliest launch in the window of the same ticker and logo (b), agreeing name (n) and logo (l), itself if none is earlier, as gap in microseconds and
    other; how many of an agreeing name were ``live``, of the ticker (named) and of the logo (marked) in the last day; and same_ticker (see ``collisions``).

    ``keys`` (ticker, name, key) and ``sizes`` (ticker, name, n) are of the distinct names. A launch's groups are made from its name's, which lose no agreement by having telling keys only. Groups of at most
    ``CROWD`` launches are ordered whole; larger ones are cut by days and hours.
    """
    groups = written(name_groups(names_with_keys(keys, sizes)), "name-groups")
    some = groups.agg(F.max(F.size("keys")).alias("keys"), F.max(F.exists("groups", lambda g: g["crowd"])).alias("crowd")).first()
    timed, crowded_logos = with_crowds(rows.filter("at IS NOT NULL").select("id", "at", "ticker", "name", "logo"))
    timed = timed.withColumn("logo", F.concat(F.lit("b:"), F.col("logo").cast("string")))
    shared = timed.join(groups.drop("keys"), ["ticker", "name"]).select("id", "at", "logo", "crowded", F.inline("groups"))
    plain = F.struct("grp", "kind", "sign", "crowd")
    with_logo = F.struct(F.concat("stem", "logo").alias("grp"), F.col("logo_kind").alias("kind"), F.col("logo_sign").alias("sign"), (F.col("crowd") & F.col("crowded")).alias("crowd"))
    entries = shared.select("id", "at", F.inline(F.array(plain, with_logo))).filter("grp IS NOT NULL")
    by_logo = timed.filter("logo IS NOT NULL").select("id", "at", F.concat(F.lit("l:"), "logo").alias("grp"), F.lit("l").alias("kind"), F.lit(0).alias("sign"), F.col("crowded").alias("crowd"))
    entries = entries.unionByName(by_logo)
    long = long_names(timed.drop("crowded"), groups.select("ticker", "name", "keys")) if (some["keys"] or 0) > MOST_KEYS else None
    spans = {"quiet": (QUIET_HOURS * 3600, 0), "day": (_DAY, 0), "aged": (_DAY, MIN_GAP), "month": (WINDOW_DAYS * _DAY, 0)}
    found = look_back(entries.filter("NOT crowd"), ("first", WINDOW_DAYS * _DAY), spans)
    # Of its counts each kind needs one, and the earliest as its gap and id.
    seen = lambda kind: F.when(kind == "n", F.col("quiet")).when(kind == "t", F.col("day")).when(kind == "l", F.col("aged")).alias("seen")
    earlier = lambda kind: [F.when(kind.isin("n", "l", "b"), c).alias(name) for name, c in (("gap", F.col("at") - F.col("first.at")), ("other", -F.col("first.other")))]
    counted = F.col("sign") * F.col("month") if long is None else F.lit(None).cast("long")
    parts = [found.select("id", "kind", *earlier(F.col("kind")), seen(F.col("kind")), counted.alias("n"))]
    crowded = None
    if crowded_logos or some["crowd"]:
        crowded = written(entries.filter("crowd"), "crowded-groups")
        of = lambda kinds: crowded.filter(F.col("kind").isin(*kinds)).select("id", "at", F.concat("kind", "grp").alias("grp"))
        kind = F.left("grp", F.lit(1))
        firsts = earliest(of("nlb"), WINDOW_DAYS).join(crowded.select("id", "at").distinct(), "id")
        parts.append(firsts.select("id", kind.alias("kind"), *earlier(kind)))
        recent = trailing.sliced(of("tnl").withColumn("ts", F.timestamp_micros("at")), "ts", max(_DAY, QUIET_HOURS * 3600))
        recent = recent.withColumns({name: trailing.count(["grp"], back, -1 - upto * SECOND) for name, (back, upto) in spans.items() if name != "month"})
        parts.append(trailing.own(recent).select("id", kind.alias("kind"), seen(kind)))
    if long is not None or crowded is not None:
        members, questions = long or (None, None)
        signed = (entries if long is not None else crowded).filter("sign != 0").select("id", "grp", "at", "sign")
        parts.append(counts_before(members, questions, WINDOW_DAYS * _DAY, own=signed).select("id", "n"))
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part, allowMissingColumns=True)
    # A launch's rows are as many as its groups, far apart: they meet before they are combined. Of several names' earliest the one with the largest gap, then id, as one number.
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    farthest = whole("gap") * F.lit(str(_IDS)).cast("decimal(20,0)") + whole("other")
    pick = lambda k, c: F.max(F.when(F.col("kind") == k, c))
    kept = together.repartition("id").groupBy("id").agg(
        *[pick(k, F.col(c)).alias(f"{k}_{c}") for k in "bl" for c in ("gap", "other")], pick("n", F.col("gap")).alias("n_gap"), pick("n", farthest).alias("farthest"),
        *[pick(k, F.col("seen")).alias(name) for k, name in (("n", "live"), ("t", "named"), ("l", "marked"))], F.sum("n").alias("same_ticker"),
    )
    return kept.withColumn("n_other", (F.col("farthest") - whole("n_gap") * F.lit(str(_IDS)).cast("decimal(20,0)")).cast("long")).drop("farthest")


def collisions(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """id and same_ticker: earlier launches in the window that have a launch's ticker, but neither an agreeing name nor its logo.

    They are all of the ticker less the union of the groups that the launch shares with others: one for each key of its name, and ticker with logo. The union is counted by
    inclusion and exclusion over the groups' intersections, of which every launch is a member too, so no launches are paired (see ``standing``).
    """
    return standing(rows, keys, rows.groupBy("ticker", "name").agg(F.count("*").alias("n"))).select("id", "same_ticker")


def launches(events: DataFrame, part: DataFrame) -> DataFrame:
    """id, ts, at, name, ticker, logo, refers. Launches are dealt over all parts by their number; those that meet no part are not launches."""
    last = part.agg(F.max("p_partkey").alias("last"))  # one row
    names = part.select("p_partkey", "p_name", F.upper(F.left(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(4))).alias("ticker"))
    named = events.crossJoin(F.broadcast(last)).withColumn("k", F.col("event_id") % (F.col("last") + 1)).join(names, F.col("k") == F.col("p_partkey"))
    ts = F.when(F.col("event_id") % 101 != 0, F.col("ts"))
    rows = named.select(
        F.col("event_id").alias("id"), ts.alias("ts"), F.col("p_name").alias("name"), "ticker",
        F.when(F.col("event_type") != "error", F.col("user_id") * 3 + F.col("event_id") % 3).alias("logo"), (F.col("event_type") == "signup").alias("refers"),
    )
    return rows.withColumn("at", micros("ts"))


def kind_of(rank: Column, age: Column) -> Column:
    """By place and by the original's age in microseconds, either of which may be missing."""
    hour = 3600 * SECOND
    late = F.coalesce(rank >= LATE_RANK, F.lit(False)) | F.coalesce(age > LATE_HOURS * hour, F.lit(False))
    early = F.coalesce(rank <= EARLY_RANK, F.lit(True)) & F.coalesce(age < EARLY_HOURS * hour, F.lit(True))
    return F.when(late, "late_copy").when(early, "early_copy").otherwise("copy")


def lineage(rows: DataFrame) -> DataFrame:
    """event_id, original, how (both, name, logo), rank, kind and same_ticker (see ``collisions``) of every launch.

    Written on the way: the launches, and for each distinct name its number, its keys and its groups.
    """
    rows = written(rows, "launches")
    names = written(rows.groupBy("ticker", "name").agg(F.count("*").alias("n")), "launch-names")
    name_keys = written(agreement_keys(names.select("ticker", "name")), "name-keys")
    e = rows.join(standing(rows, name_keys, names), "id", "left")
    place = lambda c: F.coalesce(c, F.lit(0)) + 1
    e = e.withColumns({"name_rank": place("named"), "logo_rank": place("marked"), "same_ticker": F.when(F.col("at").isNotNull(), F.coalesce("same_ticker", F.lit(0)))})
    old = lambda k: F.coalesce(F.col(f"{k}_gap") > MIN_GAP * SECOND, F.lit(False))
    earlier = lambda k: F.coalesce(F.col(f"{k}_gap") > 0, F.lit(False))
    how = F.when(old("b"), "both").when(old("n"), "name").when(old("l"), "logo")
    chosen = lambda c: F.when(old("b"), F.col(f"b_{c}")).when(old("n"), F.col(f"n_{c}")).when(old("l"), F.col(f"l_{c}"))
    e = e.withColumns({"how": how, "original": chosen("other"), "age": chosen("gap")})
    # A logo alone ranks among the earlier launches with that logo.
    e = e.withColumn("rank", F.when(F.col("how") == "logo", F.col("logo_rank")).otherwise(F.col("name_rank")))
    copied = kind_of(F.col("rank"), F.col("age"))
    quiet = ~earlier("l") & (F.coalesce(F.col("live"), F.lit(0)) == 0)
    distinct_ticker = F.col("ticker").rlike("^[A-Z]{4,}$") & ~F.lower("ticker").isin(*EVERYDAY)
    crowd = (F.col("name_rank") > 1) & (earlier("n") | earlier("b") | distinct_ticker)
    final = (
        F.when(F.col("at").isNull(), F.when(F.col("refers"), "reference").otherwise("unknown"))
        .when(F.col("how").isNull(), F.when(crowd, kind_of(F.col("name_rank"), F.lit(None).cast("long"))).when(F.col("refers"), "reference").otherwise("original"))
        .when((copied == "late_copy") & (F.col("rank") < LATE_RANK) & quiet, "reference")
        .otherwise(copied)
    )
    shown = F.when(F.col("how").isNotNull() | crowd, F.col("rank"))
    return e.select(F.col("id").alias("event_id"), "original", "how", shown.alias("rank"), final.alias("kind"), "same_ticker")


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_AGREES = f"""nm AS (SELECT DISTINCT ticker, name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS compact, string_split(lower(name), ' ') AS words FROM l),
    co AS (SELECT *, array_to_string(CASE WHEN len(list_filter(words, lambda w: w NOT IN {_in(FILLER)})) > 0 THEN list_filter(words, lambda w: w NOT IN {_in(FILLER)}) ELSE words END, '') AS core,
      list_filter(words, lambda w: length(w) >= {WORD_LETTERS} AND w NOT IN {_in(EVERYDAY + FILLER)}) AS own FROM nm),
    pr AS (SELECT a.ticker, a.name AS a, b.name AS b, a.core AS x, b.core AS y, a.compact = b.compact OR a.core = b.core OR list_has_any(a.own, b.own) AS same FROM co a JOIN co b ON a.ticker = b.ticker),
    lc AS (SELECT *, list_last(list_reduce(list_transform(string_split(x, ''), lambda c: [ascii(c)::BIGINT]), lambda acc, c: list_reduce(list_transform(range(1, length(y) + 1), lambda j: [j::BIGINT]),
        lambda row, j: list_append(row, CASE WHEN ascii(y[j[1]]) = c[1] THEN acc[j[1]] + 1 ELSE greatest(acc[j[1] + 1], row[j[1]]) END), [0::BIGINT]), list_transform(range(0, length(y) + 1), lambda j: 0::BIGINT))) AS common FROM pr),
    ag AS (SELECT ticker, a, b FROM lc WHERE same OR (least(length(x), length(y)) >= {FUZZY_LETTERS} AND 2.0 * common / (length(x) + length(y)) >= {FUZZY}))"""
_LINEAGE = f"""l AS (SELECT event_id AS id, CASE WHEN event_id % 101 != 0 THEN ts END AS ts, p_name AS name, upper(left(split_part(p_name, ' ', 2), 4)) AS ticker,
      CASE WHEN event_type != 'error' THEN user_id * 3 + event_id % 3 END AS logo, event_type = 'signup' AS refers FROM events JOIN part ON p_partkey = event_id % (SELECT max(p_partkey) + 1 FROM part)),
    {_AGREES},
    p AS (SELECT a.id, b.id AS other, a.ts - b.ts AS gap, a.ticker = b.ticker AS namesake, a.ticker = b.ticker AND EXISTS (SELECT 1 FROM ag WHERE ag.ticker = a.ticker AND ag.a = a.name AND ag.b = b.name) AS agrees, coalesce(a.logo = b.logo, false) AS logo
      FROM l a JOIN l b ON a.id != b.id AND (a.ticker = b.ticker OR a.logo = b.logo) AND b.ts BETWEEN a.ts - INTERVAL {WINDOW_DAYS} DAY AND a.ts),
    g AS (SELECT id,
        max(struct_pack(gap := gap, other := other)) FILTER (WHERE gap > INTERVAL {MIN_GAP} SECOND AND namesake AND logo) AS b, max(struct_pack(gap := gap, other := other)) FILTER (WHERE gap > INTERVAL {MIN_GAP} SECOND AND agrees) AS n,
        max(struct_pack(gap := gap, other := other)) FILTER (WHERE gap > INTERVAL {MIN_GAP} SECOND AND logo) AS lo, coalesce(bool_or(gap > INTERVAL 0 SECOND AND (agrees OR namesake AND logo)), false) AS crowd,
        coalesce(bool_or(gap > INTERVAL 0 SECOND AND logo), false) AS any_logo, coalesce(bool_or(gap > INTERVAL 0 SECOND AND agrees AND gap <= INTERVAL {QUIET_HOURS} HOUR), false) AS live,
        count(*) FILTER (WHERE namesake AND gap > INTERVAL 0 SECOND AND NOT agrees AND NOT logo) AS same_ticker,
        1 + count(*) FILTER (WHERE namesake AND gap > INTERVAL 0 SECOND AND gap <= INTERVAL 24 HOUR) AS name_rank, 1 + count(*) FILTER (WHERE logo AND gap > INTERVAL {MIN_GAP} SECOND AND gap <= INTERVAL 24 HOUR) AS logo_rank FROM p GROUP BY id),
    e AS (SELECT l.*, CASE WHEN b IS NOT NULL THEN 'both' WHEN n IS NOT NULL THEN 'name' WHEN lo IS NOT NULL THEN 'logo' END AS how, coalesce(b, n, lo) AS x, coalesce(any_logo, false) AS any_logo, coalesce(live, false) AS live,
        coalesce(same_ticker, 0) AS same_ticker, coalesce(name_rank, 1) AS name_rank, coalesce(logo_rank, 1) AS logo_rank, coalesce(crowd, false) OR (length(ticker) >= 4 AND lower(ticker) NOT IN {_in(EVERYDAY)}) AS crowd FROM l LEFT JOIN g USING (id)),
    f AS (SELECT *, CASE WHEN how = 'logo' THEN logo_rank ELSE name_rank END AS place FROM e),
    k AS (SELECT *, CASE WHEN place >= {LATE_RANK} OR x.gap > INTERVAL {LATE_HOURS} HOUR THEN 'late_copy' WHEN place <= {EARLY_RANK} AND coalesce(x.gap < INTERVAL {EARLY_HOURS} HOUR, true) THEN 'early_copy' ELSE 'copy' END AS copied FROM f)"""


@pack.query(
    "events", "part",
    sql=f"""WITH {_LINEAGE} SELECT id AS event_id, x.other AS original, how, CASE WHEN ts IS NOT NULL AND (how IS NOT NULL OR (name_rank > 1 AND crowd)) THEN place END AS rank,
      CASE WHEN ts IS NULL THEN CASE WHEN refers THEN 'reference' ELSE 'unknown' END WHEN how IS NULL THEN CASE WHEN name_rank > 1 AND crowd THEN copied WHEN refers THEN 'reference' ELSE 'original' END
        WHEN copied = 'late_copy' AND place < {LATE_RANK} AND NOT any_logo AND NOT live THEN 'reference' ELSE copied END AS kind, CASE WHEN ts IS NOT NULL THEN same_ticker END AS same_ticker FROM k""",
)
def lineage_full(events: DataFrame, part: DataFrame) -> DataFrame:
    """Each launch's original (name and logo, else name, else logo; over five minutes older, the earliest in thirty days), its place, and its kind."""
    return lineage(launches(events, part))


@pack.query("part", sql=f"WITH l AS (SELECT DISTINCT p_name AS name, upper(left(split_part(p_name, ' ', 2), 4)) AS ticker FROM part), {_AGREES} SELECT ticker, a AS name, count(*) AS agreeing FROM ag GROUP BY ALL")
def name_agreement(part: DataFrame) -> DataFrame:
    """How many names of the same ticker agree with each name: equal, equal without filler, of close spelling, or with a distinctive word in common."""
    names = part.select(F.upper(F.left(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(4))).alias("ticker"), F.col("p_name").alias("name")).distinct()
    keys = agreement_keys(names)
    pairs = keys.join(keys.withColumnRenamed("name", "other"), ["ticker", "key"])
    return pairs.groupBy("ticker", "name").agg(F.count_distinct("other").alias("agreeing"))


@pack.query(
    "events", "part",
    sql=f"WITH {_LINEAGE} SELECT a.id AS event_id, " + ", ".join(f"1 + count(p.other) FILTER (WHERE p.gap <= INTERVAL {h} HOUR) AS siblings_{h}h" for h in (1, 6, 24)) + " FROM l a LEFT JOIN p USING (id) WHERE a.ts IS NOT NULL GROUP BY a.id",
)
def lineage_siblings(events: DataFrame, part: DataFrame) -> DataFrame:
    """Launches of the last 1, 6 and 24 hours that share the ticker or the logo, this one included: counted by each and by both."""
    dealt = trailing.sliced(launches(events, part).filter("ts IS NOT NULL").select("id", "ts", "ticker", "logo"), "ts", _DAY)
    hours = (1, 6, 24)
    # Ticker before both: its rows lie together already.
    counted = dealt.withColumns({f"t{h}": trailing.count(["ticker"], h * 3600) for h in hours}).withColumns({f"b{h}": trailing.count(["ticker", "logo"], h * 3600) for h in hours})
    counted = counted.withColumns({f"l{h}": trailing.count(["logo"], h * 3600) for h in hours})
    within = lambda h: F.col(f"t{h}") + F.when(F.col("logo").isNotNull(), F.col(f"l{h}") - F.col(f"b{h}")).otherwise(0)
    return trailing.own(counted).select(F.col("id").alias("event_id"), *[within(h).alias(f"siblings_{h}h") for h in hours])
