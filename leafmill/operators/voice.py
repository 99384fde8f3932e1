"""Voices: which suit, how they rank for an article, catalogues that are refreshed in part, and who decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.cache import running_before
from leafmill.operators.values import utf16_units

Column = F.Column

# Registers of writing by the words that show them, and the voice tags each wants and clashes with.
PROFILES = [
    ("reportage", r"news|politic|policy|election|business|econom|finance|market|war|court|law|crime|investigat", "clear professional authoritative crisp measured confident serious neutral-tone", "warm gentle intimate soft breathy dramatic mysterious", 1.03, 0.6),
    ("essay", r"essay|opinion|culture|book|literat|history|philosoph|art|film|movie|music|memoir|review|poet", "warm measured storytelling calm expressive smooth narrative gentle", "crisp authoritative fast confident", 0.97, 0.78),
    ("technical", r"tech|ai|software|programming|engineer|science|research|data|security|physics|biolog|math", "clear professional educational neutral-tone calm measured teacher articulate", "dramatic expressive breathy raspy cinematic mysterious", 1.0, 0.58),
    ("feature", r"profile|interview|travel|food|sport|health|life|design|fashion|game|feature", "conversational friendly warm expressive bright host smooth sincere", "serious authoritative deep low slow", 1.0, 0.74),
]
GENERAL = ("general", "", "clear calm measured storytelling professional smooth", "dramatic breathy raspy", 1.0, 0.7)
READS_PROSE = "narration storytelling narrative audiobook documentary educational teacher host".split()
OFF_REGISTER = "social-media advertisement entertainment influencer motivational fitness energetic enthusiastic playful animated cheerful fast dynamic high".split()
UNSUITABLE = "singing character cartoon villain child robot asmr".split()
DENIED = "test clone demo".split()


def tone_profile(title: Column, site: Column, tags: Column, excerpt: Column) -> Column:
    """The first register whose words are there."""
    text = F.concat_ws(" ", title, site, F.array_join(tags, " "), excerpt)
    out = F.lit(GENERAL[0])
    for name, words, *_ in reversed(PROFILES):
        out = F.when(text.rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{words})"), F.lit(name)).otherwise(out)
    return out


def pace(profile: Column, words: Column) -> Column:
    """The register's speed, eased for a long read."""
    base = F.create_map(*[F.lit(x) for p in [*PROFILES, GENERAL] for x in (p[0], p[4])])[profile]
    return F.round(F.when(words > 2500, base - 0.03).otherwise(base), 4)


def hash_number(text: Column) -> Column:
    """FNV-1a of 32 bits over the text's UTF-16 code units."""
    return F.aggregate(utf16_units(text), F.lit(2166136261).cast("long"), lambda h, unit: (h.bitwiseXOR(unit) * 16777619).bitwiseAND(F.lit(4294967295).cast("long")))


def tags_in(tags: Column, names: list[str]) -> Column:
    """How many tags, repeated ones as often, are among the names."""
    wanted = F.array(*map(F.lit, names))
    return F.size(F.filter(tags, lambda t: F.array_contains(wanted, t)))


def voice_score(tags: Column, popularity: Column, jitter: Column, recent: Column, want: list[str], clash: list[str]) -> Column:
    """Three times the harmonic mean of coverage and focus, small rewards and costs, a stable jitter, and a cost for the familiar."""
    matched, n = tags_in(tags, want), F.size(tags)
    # coverage and focus combine to 2 * matched / (wanted + tags)
    fit = F.when((matched > 0) & (n > 0), 2.0 * matched / (len(want) + n)).otherwise(0.0)
    prose = F.least(F.lit(2), tags_in(tags, READS_PROSE)) * 0.35
    off = F.least(F.lit(3), tags_in(tags, OFF_REGISTER)) * 0.3
    against = F.least(F.lit(3), tags_in(tags, clash)) * 0.2
    known = F.least(F.lit(0.15), F.log10(1 + F.coalesce(popularity, F.lit(0))) / 50)
    return fit * 3 + prose - off - against + known + jitter - F.when(recent, 1.1).otherwise(0.0)


def voice_key(title: Column, id_: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.nullif(title, F.lit("")), id_.cast("string"))), "[^a-z0-9]+", "")


def ranked(voices: DataFrame, score: Column, suited: int = 6) -> DataFrame:
    """The best clone of each voice name, ranked; the first few suit. Ties by id. Names are reduced first, then ranks are counted by stretches of the score."""
    v = voices.withColumn("score", score).withColumn("key", voice_key(F.col("title"), F.col("id")))
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    clones = v.withColumn("_r", best).where("_r = 1").drop("_r")
    ahead = running_before(clones.withColumn("_one", F.lit(1)), F.floor(-F.col("score") * 1024), [F.desc("score"), "id"], "_one", "_ahead")
    return ahead.withColumn("rank", (F.col("_ahead") + 1).cast("int")).drop("_one", "_ahead").withColumn("suits", F.col("rank") <= suited)


def usable(voices: DataFrame) -> DataFrame:
    """Trained, public, standing voices with a title, tags and none that disqualifies."""
    title = F.lower(F.coalesce("title", F.lit("")))
    denied = F.lit(False)
    for word in DENIED:
        denied = denied | F.contains(title, F.lit(word))
    return voices.where((F.col("state") == "trained") & (F.col("visibility") == "public") & ~F.coalesce("taken_down", F.lit(False)) & (title != "") & ~denied & (F.size("tags") > 0) & ~F.arrays_overlap("tags", F.array(*map(F.lit, UNSUITABLE))))


def first_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def catalogue_merge(pages: DataFrame, old: DataFrame, any_failed: bool) -> DataFrame:
    """Pages (page, pos, id, ...) with first-wins ids; where a page failed, old rows that aren't among them stay."""
    new = first_by(pages, ["id"], "page", "pos").drop("page", "pos").withColumn("fresh", F.lit(True))
    if not any_failed:
        return new
    return new.unionByName(old.join(new, "id", "left_anti").withColumn("fresh", F.lit(False)))


def with_roles(catalogue: DataFrame, roles: DataFrame) -> DataFrame:
    """Catalogue rows with the first role (role, id, ord) that names them."""
    role = first_by(roles, ["id"], "ord").select("id", "role")
    return catalogue.join(role, "id", "left")


def chosen_voice(articles: DataFrame) -> DataFrame:
    """Columns lock, own, default_voice, saved_auto, configured, fresh_auto -> the voice that reads and what decided."""
    order = ["lock", "own", "default_voice", "saved_auto", "configured", "fresh_auto"]
    source = F.lit("provider")
    for c in reversed(order):
        source = F.when(F.col(c).isNotNull(), F.lit(c)).otherwise(source)
    return articles.select("id", F.coalesce(*order).alias("voice"), source.alias("source"))


def retry_after(header: Column, now: Column) -> Column:
    """Milliseconds that a Retry-After header asks for, as seconds or as a date; null for neither."""
    seconds = F.trim(header).try_cast("double")
    at = F.try_to_timestamp(F.regexp_replace(F.trim(header), r"^\w+, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.greatest(F.unix_millis(at) - F.unix_millis(now), F.lit(0))
    return F.when(seconds >= 0, (seconds * 1000).cast("long")).when(at.isNotNull(), wait)


def error_class(status: Column) -> Column:
    return (
        F.when(status.isin(401, 403), "auth").when(status == 402, "quota").when(status == 429, "rate_limited").when(status.isin(408, 504), "timeout")
        .when(status.between(500, 599), "provider_down").when(status.between(400, 499), "bad_request").otherwise("unknown")
    )


def is_retryable(status: Column) -> Column:
    return F.coalesce(status.isin(408, 425, 429, 500, 502, 503, 504), F.lit(False))


def backoff(attempt: Column, r: Column) -> Column:
    """700 ms doubled each time, half to one and a half of it."""
    return F.floor(700 * F.pow(F.lit(2.0), attempt) * (0.5 + r) + 0.5).cast("long")


def mp3_seconds(size: Column, id3: Column, bitrate: int = 64) -> Column:
    return F.floor(F.greatest(size - id3, F.lit(0)) * 8.0 / bitrate + 0.5) / 1000


def segment_style(kind: Column, speed: Column, temperature: Column) -> tuple[Column, Column]:
    """Speed and temperature of a passage: headings slow, quotes slower and looser; both clamped."""
    s = F.when(kind == "heading", 0.95).when(kind == "quote", 0.96).otherwise(1.0)
    t = F.when(kind == "quote", temperature + 0.06).otherwise(temperature)
    return F.least(F.lit(2.0), F.greatest(F.lit(0.5), speed * s)), F.least(F.lit(1.0), F.greatest(F.lit(0.1), t))


def segment_policy(raw: Column) -> Column:
    """struct(target, most) of a configured cap: 60 to 2000, else 450; the target is 300 or the cap."""
    cap = raw.try_cast("double")
    fine = (cap > 0) & (cap == F.floor(cap))
    most = F.when(fine, F.greatest(F.lit(60), F.least(cap, F.lit(2000)))).otherwise(450).cast("long")
    return F.struct(F.least(F.lit(300), most).cast("long").alias("target"), most.alias("most"))


def search_page(voices: DataFrame, q: str, page: int, size: int = 60) -> DataFrame:
    """A page of the voices whose title, tags or description hold the query, by popularity, then id."""
    needle = q.strip().lower()
    text = F.lower(F.concat_ws(" ", "title", F.array_join("tags", " ")))
    found = voices.where(F.contains(text, F.lit(needle))) if needle else voices
    top = found.orderBy(F.desc("popularity"), "id").limit((page + 1) * size)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("popularity"), "id"))).where(F.col("rank") > page * size)


def latest_of_script(variants: DataFrame) -> DataFrame:
    """The variant (article_id, script_id, rev, used) of each script that was used last, the greater rev of equals."""
    return variants.groupBy("article_id", "script_id").agg(F.max_by("rev", F.struct("used", "rev")).alias("rev"), F.max("used").alias("used"))
