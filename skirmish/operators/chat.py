"""Chat analytics: correlated messages, corpora with context, speaker profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions import chatter, times
from skirmish.operators.ordered import SPAN, Carry, scan

KEYS = ["stream_id"]

# Fixed values.
CORRELATE_SECS = 30
CONTEXT_SECS = 60
MIN_MESSAGES = 15

# Archetypes with verbosity, humor and patience.
ARCHETYPES = {
    "QuietAnchor": (0.28, 0.40, 0.78),
    "ChaoticNarrator": (0.78, 0.65, 0.58),
    "RaidLeader": (0.48, 0.30, 0.72),
    "ReactiveObserver": (0.18, 0.25, 0.80),
    "TacticalFocused": (0.50, 0.20, 0.70),
}
_UNKNOWN = (0.50, 0.40, 0.65)

# Control tokens, in the order of their ids.
CONTROL_TOKENS = [
    "[ARCH]", "[REG]", "[TRIG]", "[RESPONSE]",
    "[QuietAnchor]", "[ChaoticNarrator]", "[RaidLeader]", "[Unknown]",
    "[Neutral]", "[Frustrated]", "[Elated]", "[Tired]", "[Engaged]",
    "[MobKilled]", "[PlayerDied]", "[SpellResisted]", "[BigHit]",
    "[NearDeath]", "[CasterOom]", "[Incoming]", "[Loot]", "[LevelUp]",
    "[Wipe]", "[Banter]",
    "[VERBOSE]", "[TERSE]",
    "[HUMOROUS]", "[SERIOUS]",
    "[PATIENT]", "[IMPATIENT]",
]

_Q = "['\"]"
_TEXT = f", {_Q}(.+?){_Q}$"
_W = r"([\p{L}\p{N}_]+)"
# Channel, regex on the line body, and whether group 1 is the speaker.
CHAT_PATTERNS = [
    ("guild", rf"^{_W} tells the guild{_TEXT}", True),
    ("guild", rf"^You say to your guild{_TEXT}", False),
    ("group", rf"^{_W} tells the group{_TEXT}", True),
    ("group", rf"^You tell your party{_TEXT}", False),
    ("voice", rf"^{_W} voice-tells the group{_TEXT}", True),
    ("say", rf"^You say{_TEXT}", False),
    ("say", rf"^{_W} says{_TEXT}", True),
    ("shout", rf"^You shout{_TEXT}", False),
    ("shout", rf"^{_W} shouts{_TEXT}", True),
    ("ooc", rf"^You say out of character{_TEXT}", False),
    ("ooc", rf"^{_W} says out of character{_TEXT}", True),
]

# Game events for the context: kind, regex, and the summary as a rewrite with the
# actor in group 1 ("You" when that group is empty).
GAME_PATTERNS = [
    ("slay", rf"^(?:{_W} has slain|You have slain) (.+)!", "{who} slew $2"),
    ("death", rf"^{_W} has been slain by (.+)!", "$1 slain by $2"),
    ("death_self", r"^You have been slain by (.+)!", "You slain by $1"),
    ("resist", r"^Your (.+?) spell did not take hold", "resist: $1"),
    ("resist_other", r"^(.+?) hit (.+?) for \d+ points? of [\p{L}\p{N}_]+ damage\.", "resist_other"),
    ("cast", rf"^(?:You begin|{_W} begins) casting (.+?)\.", "{who} casting $2"),
    ("big_hit", rf"^(?:You|{_W}) (?:hit|struck) (.+?) for (\d+) points?", "{who} hit $2 for $3"),
    ("loot", rf"^(?:You|{_W}) (?:have looted|looted) (?:a|an|the) (.+?) from", "{who} looted $2"),
    ("zone", r"^You have entered (.+?)\.", "zone: $1"),
    ("oom", rf"^(?:You are|{_W} is) out of mana\.", "{who} OOM"),
    ("level", rf"^(?:You have|{_W} has) reached level (\d+)", "{who} reached level $2"),
]


def parse_corpus_chat(body: Column, owner: Column) -> Column:
    """Struct of channel, speaker and text for the eleven chat shapes, else null."""
    out = F
    for channel, rx, other in CHAT_PATTERNS:
        at = 2 if other else 1
        speaker = F.regexp_extract(body, rx, 1) if other else owner
        out = out.when(body.rlike(rx), F.struct(F.lit(channel).alias("channel"), speaker.alias("speaker"), F.trim(F.regexp_extract(body, rx, at)).alias("text")))
    found = F.when(F.contains(body, F.lit(", ")), out.otherwise(F.lit(None)))
    return F.when(F.coalesce(found["text"], F.lit("")) != "", found)


def parse_game_event(body: Column) -> Column:
    """Struct of kind and summary for the eleven context events, else null."""
    out = F
    for kind, rx, summary in GAME_PATTERNS:
        text = F.regexp_replace(F.regexp_extract(body, rx, 0), rx, summary.replace("{who}", "$1"))
        if "{who}" in summary:
            text = F.when(F.regexp_extract(body, rx, 1) == "", F.concat(F.lit("You"), text)).otherwise(text)
        out = out.when(body.rlike(rx), F.struct(F.lit(kind).alias("kind"), text.alias("summary")))
    return out.otherwise(F.lit(None))


def chat_context(rows: DataFrame, window: int = CONTEXT_SECS, keys: list[str] = KEYS, order: str = "line_no") -> DataFrame:
    """Messages with all game events of the last ``window`` seconds before them, in line order.

    ``rows`` has ``msg`` and ``event`` structs.  Time is cut into buckets of the window length
    and events are copied to their own and the next bucket, so each message finds its whole
    window inside one bucket and no stream becomes one task.
    """
    bucket = F.floor(F.col("ts") / window)
    ev = rows.filter(F.col("event").isNotNull()).select(
        *keys, order, "ts", F.col("event"), F.explode(F.array(bucket, bucket + 1)).alias("_b"), F.lit(None).cast("long").alias("_own"))
    ms = rows.filter(F.col("msg").isNotNull()).drop("event").withColumns({"_b": bucket, "_own": F.col(order)})
    both = ms.unionByName(ev, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_b").orderBy("ts").rangeBetween(-window, 0)
    item = F.when(F.col("event").isNotNull(), F.struct(F.col(order).alias("line"), F.col("event.kind").alias("kind"), F.col("event.summary").alias("summary")))
    both = both.withColumn("_ctx", F.collect_list(item).over(w)).filter(F.col("_own").isNotNull())
    ctx = F.array_sort(F.filter("_ctx", lambda e: e["line"] <= F.col("_own")))
    return both.withColumn("context", F.transform(ctx, lambda e: F.struct(e["kind"].alias("kind"), e["summary"].alias("summary")))).drop("_b", "_own", "_ctx", "event")


def label_archetype(rows: DataFrame, archetypes: DataFrame | None) -> DataFrame:
    """Add the speaker's archetype, ``Unknown`` by default."""
    if archetypes is None:
        return rows.withColumn("archetype", F.lit("Unknown"))
    return rows.join(archetypes.select("speaker", F.col("archetype").alias("_a")), "speaker", "left").withColumn(
        "archetype", F.coalesce("_a", F.lit("Unknown"))).drop("_a")


def extract_corpus(
    lines: DataFrame, archetypes: DataFrame | None = None, window: int = CONTEXT_SECS, include_unknown: bool = False,
    channels: list[str] | None = None, raw: str = "raw", keys: list[str] = KEYS, order: str = "line_no",
) -> DataFrame:
    """Labelled chat messages with the game events before them; lines without a time are skipped."""
    body = times.strip_prefix(F.col(raw))
    rows = lines.withColumn("ts", times.line_epoch(F.col(raw))).filter(F.col("ts").isNotNull()).withColumn("_body", body)
    rows = rows.withColumns({"msg": parse_corpus_chat(F.col("_body"), F.col("player")), "event": parse_game_event(F.col("_body"))})
    rows = rows.filter(F.col("msg").isNotNull() | F.col("event").isNotNull()).select(*keys, order, "ts", "msg", "event")
    out = chat_context(rows, window, keys, order).select(*keys, order, "ts", "msg.*", "context")
    if channels:
        out = out.filter(F.col("channel").isin(channels))
    out = label_archetype(out, archetypes)
    return out if include_unknown else out.filter(F.col("archetype") != "Unknown")


def corpus_stats(corpus: DataFrame, top: int = 15) -> DataFrame:
    """Counts by archetype (with percent), by channel, and of the top speakers, in one table."""
    # Counts per distinct combination first, so the three tables read a small frame.
    small = corpus.groupBy("archetype", "channel", "speaker").agg(F.count(F.lit(1)).alias("n"))
    total = small.agg(F.sum("n").alias("total"))
    by = lambda c: small.groupBy(F.col(c).alias("value")).agg(F.sum("n").alias("n"))
    arch = by("archetype").crossJoin(F.broadcast(total)).select(  # one row
        F.lit("archetype").alias("stat"), "value", "n", F.round(F.col("n") * 100.0 / F.col("total"), 1).alias("percent"))
    none = F.lit(None).cast("double").alias("percent")
    chan = by("channel").select(F.lit("channel").alias("stat"), "value", "n", none)
    spk = by("speaker").orderBy(F.col("n").desc(), "value").limit(top).select(F.lit("speaker").alias("stat"), "value", "n", none)
    return arch.unionByName(chan).unionByName(spk)


def parse_group_chat(body: Column, owner: Column) -> Column:
    """Struct of speaker, channel and text for group and raid chat, by plain text tests."""
    rest = F.substring_index(F.substring_index(body, ", '", 1), " ", -1)
    text = F.regexp_replace(body.substr(F.instr(body, F.lit(", '")) + 3, F.lit(1 << 30)), "'+$", "")
    mine = body.startswith("You tell your ") & (F.substring_index(body, ", '", 1) == F.concat(F.lit("You tell your "), rest))
    speaker = F.substring_index(body, " tells the ", 1)
    other = ~body.startswith("You tell your ") & F.contains(body, F.lit(" tells the ")) & ~F.contains(speaker, F.lit(" ")) & (
        F.substring_index(body, ", '", 1) == F.concat(speaker, F.lit(" tells the "), rest))
    channel = F.when(mine & (rest == "party"), "group").when(mine & (rest == "raid"), "raid").when(other & rest.isin("group", "raid"), rest)
    return F.when(F.contains(body, F.lit(", '")) & channel.isNotNull(),
                  F.struct(F.when(mine, owner).otherwise(speaker).alias("speaker"), channel.alias("channel"), text.alias("text")))


def classify_event(body: Column) -> Column:
    """Struct of kind and detail for lines that chat reacts to, else null."""
    out = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    after = lambda p: F.substring(body, len(p) + 1, 1 << 30)
    bang = lambda c: F.regexp_replace(c, "!+$", "")
    has = lambda w: F.contains(body, F.lit(w))
    none = F.lit("")
    return (
        F.when(has(" has been slain by "), out("slay", F.substring_index(body, " has been slain by ", 1)))
        .when(body.startswith("You have slain "), out("slay", bang(after("You have slain "))))
        .when(body.startswith("You have been slain by "), out("player_death", bang(after("You have been slain by "))))
        .when(body.endswith(" died."), out("player_death", F.regexp_replace(body, r" died\.$", "")))
        .when(has(" resisted ") | body.startswith("You resist "), out("resist", none))
        .when(body.startswith("--You have looted "), out("item_loot", F.substring_index(after("--You have looted "), " from", 1)))
        .when(body.startswith("You receive ") & has(" from "), out("item_loot", F.substring_index(after("You receive "), " from", 1)))
        .when(body.startswith("You gain") & has("experience"), out("exp_gain", none))
    )


def correlate_chat(
    lines: DataFrame, window: int = CORRELATE_SECS, speaker: str | None = None, raw: str = "raw",
    keys: list[str] = KEYS, order: str = "line_no", span: int = SPAN,
) -> DataFrame:
    """Group and raid messages with the latest game event at most ``window`` seconds before."""
    rows = lines.withColumns({"ts": times.line_epoch(F.col(raw)), "_body": times.strip_prefix(F.col(raw))}).filter(F.col("ts").isNotNull())
    rows = rows.withColumn("msg", parse_group_chat(F.col("_body"), F.col("player")))
    rows = rows.withColumn("event", F.when(F.col("msg").isNull(), classify_event(F.col("_body"))))
    rows = rows.filter(F.col("msg").isNotNull() | F.col("event").isNotNull()).select(*keys, order, "ts", "msg", "event")
    mark = F.when(F.col("event").isNotNull(), F.struct("ts", "event.kind", "event.detail"))
    out = scan(rows, keys, order, [Carry("_ev", "last", mark, inclusive=False)], span).filter(F.col("msg").isNotNull())
    if speaker is not None:
        out = out.filter(F.col("msg.speaker") == speaker)
    near = F.coalesce(F.col("_ev.ts") >= F.col("ts") - window, F.lit(False))
    pick = lambda c: F.when(near, c)
    return out.select(
        *keys, order, "ts", "msg.*", chatter.message_class(F.col("msg.text"), near).alias("msg_class"),
        pick(F.col("_ev.kind")).alias("event_kind"), pick(F.col("_ev.detail")).alias("event_detail"),
        pick(F.col("ts") - F.col("_ev.ts")).alias("event_lag_secs"))


def flat_corpus(correlated: DataFrame) -> DataFrame:
    return correlated.select("speaker", "channel", "text")


def speaker_stats(correlated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Messages per class, average length and upper median reaction time of each speaker.

    The median comes from counts per distinct lag, of which there are at most the window
    length, so no speaker's messages are ever collected.
    """
    g = [*(by or []), "speaker"]
    is_ = lambda c: F.count_if(F.col("msg_class") == c)
    out = correlated.groupBy(*g).agg(
        F.count(F.lit(1)).alias("total"), is_("reactive").alias("reactive"), is_("real_life").alias("rl_meta"),
        is_("tactical").alias("tactical"), is_("loot").alias("loot"), is_("social").alias("social"),
        F.sum(F.length("text")).alias("_len"))
    lags = correlated.filter((F.col("msg_class") == "reactive") & F.col("event_lag_secs").isNotNull()).groupBy(*g, "event_lag_secs").agg(
        F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*g).orderBy("event_lag_secs")
    lags = lags.withColumns({"_upto": F.sum("n").over(w), "_all": F.sum("n").over(Window.partitionBy(*g))})
    median = lags.filter(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*g).agg(F.min("event_lag_secs").alias("median_reaction_secs"))
    out = out.join(median, g, "left")
    return out.withColumns({
        "avg_msg_len": F.round(F.col("_len") / F.col("total"), 1),
        "median_reaction_secs": F.coalesce("median_reaction_secs", F.lit(0).cast("long")),
    }).drop("_len")


HUMOR = r"(?iU)\b(?:lol|lmao|lmfao|rofl|haha|hehe|heh|xd|kek|gg)\b|(?<!\w):[-o]?[)DdPp3]|(?<!\w);[-]?[)]"
CAPS = r"(?U)\b[A-Z]{3,}\b"


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))


def speaker_features(corpus: DataFrame, min_messages: int = MIN_MESSAGES) -> DataFrame:
    """Verbosity, humor and patience of every speaker with enough messages, in 0 to 1."""
    frac = lambda cond: F.count_if(cond)
    raw = corpus.groupBy("speaker").agg(
        F.count(F.lit(1)).alias("n"), F.sum(word_count(F.col("text"))).alias("words"), frac(F.col("text").rlike(HUMOR)).alias("humor_n"),
        frac(F.rtrim("text").endswith("!")).alias("exclaim_n"), frac(F.col("text").rlike(CAPS)).alias("caps_n"))
    raw = raw.filter(F.col("n") >= min_messages)
    n = F.col("n")
    raw = raw.withColumns({"avg_words": F.col("words") / n, "humor_frac": F.col("humor_n") / n, "exclaim_frac": F.col("exclaim_n") / n, "caps_frac": F.col("caps_n") / n})
    top = raw.agg(F.max("avg_words").alias("_max"))
    out = raw.crossJoin(F.broadcast(top))  # one row
    one = F.lit(1.0)
    return out.withColumns({
        "verbosity": F.least(F.col("avg_words") / F.greatest(F.col("_max"), one), one),
        "humor": F.least(F.col("humor_frac") * 2.5 + F.col("exclaim_frac") * 0.4 + F.col("caps_frac") * 0.3, one),
        "patience": F.greatest(F.lit(0.0), F.least(one, F.lit(0.92) - F.col("exclaim_frac") * 0.7 - F.col("caps_frac") * 0.3)),
    }).drop("_max", "words", "humor_n", "exclaim_n", "caps_n")


def rank_archetypes(features: DataFrame, top: int = len(ARCHETYPES)) -> DataFrame:
    """Nearest archetypes of each speaker.  The five profiles are literals of the plan."""
    dist = lambda v: F.sqrt(sum((F.col(d) - F.lit(x)) * (F.col(d) - F.lit(x)) for d, x in zip(("verbosity", "humor", "patience"), v)))
    rows = F.array_sort(F.array(*[
        F.struct(dist(v).alias("dist"), F.lit(i).alias("i"), F.lit(a).alias("archetype")) for i, (a, v) in enumerate(ARCHETYPES.items())]))
    out = features.select("speaker", F.posexplode(F.slice(rows, 1, top)).alias("pos", "r"))
    return out.select("speaker", (F.col("pos") + 1).alias("rank"), "r.archetype", "r.dist")


def suggest_map(features: DataFrame, known: DataFrame) -> DataFrame:
    """Best archetype for speakers without a label."""
    labelled = known.filter(F.col("archetype") != "Unknown").select("speaker")
    return rank_archetypes(features, 1).join(labelled, "speaker", "left_anti").select("speaker", "archetype")


def training_prefix(corpus: DataFrame) -> DataFrame:
    """Control tokens before each message, and the text that fills the slot."""
    known = F.array(*[F.lit(t) for t in CONTROL_TOKENS])
    token = lambda c, default: F.when(F.array_contains(known, F.concat(F.lit("["), c, F.lit("]"))), F.concat(F.lit("["), c, F.lit("]"))).otherwise(default)
    reg, trig = chatter.classify_register(F.col("context")), chatter.classify_trigger(F.col("context"))
    arch = F.coalesce("archetype", F.lit("Unknown"))
    trait = [
        reduce(lambda acc, kv: acc.when(arch == kv[0], kv[1][i]), ARCHETYPES.items(), F).otherwise(_UNKNOWN[i]) for i in range(3)]
    rows = corpus.withColumns({"register": reg, "trigger": trig})
    head = F.array(
        F.lit("[ARCH]"), token(arch, "[Unknown]"), F.lit("[REG]"), token(F.col("register"), "[Neutral]"),
        F.lit("[TRIG]"), token(F.col("trigger"), "[Banter]"))
    return rows.withColumns({
        "tokens": F.concat(head, chatter.personality_buckets(*trait)),
        "slot": chatter.slot_text(F.col("context"), F.col("trigger")),
    })


def training_set(
    prefixed: DataFrame, encode, vocab_size: int, eos: int, pad: int, max_len: int | None = None, val_frac: float = 0.05, key: str = "line_no",
) -> DataFrame:
    """Id sequences with the prefix length, the full length and the split.

    With ``max_len`` every sequence is cut or padded to that length, the response first and then the prefix;
    ``full_len`` tells what it was.  Without it sequences keep their own length.
    ``encode`` turns a text into a list of ids; it runs on Arrow batches inside tasks.  The
    split takes the lowest hashes of the row key: ``max(1, n * val_frac)`` rows are held out.
    """
    ids = {t: vocab_size + i for i, t in enumerate(CONTROL_TOKENS)}

    def batches(frames):
        for pdf in frames:
            prefix, seqs, lengths = [], [], []
            for tokens, slot, text in zip(pdf["tokens"], pdf["slot"], pdf["text"]):
                p = [ids[t] for t in tokens] + (list(encode(slot)) if slot else []) + [ids["[RESPONSE]"]]
                full = p + (list(encode(text)) + [eos])
                size = len(full) if max_len is None else max_len
                prefix.append(min(len(p), size))
                lengths.append(len(full))
                seqs.append((full + [pad] * (size - len(full)))[:size])
            yield pdf[["_key"]].assign(seq=seqs, prefix_len=prefix, full_len=lengths)

    rows = prefixed.select(F.struct(*[F.col(c) for c in _row_key(prefixed, key)]).alias("_k"), "tokens", "slot", "text")
    rows = rows.select(F.xxhash64("_k").alias("_key"), "tokens", "slot", "text")
    out = rows.mapInPandas(batches, "_key long, seq array<int>, prefix_len int, full_len int")
    # The cut comes from counts per hash range (at most 65,536 rows), then from the one range
    # that crosses it; no global sort.
    part = F.shiftright("_key", 48)
    counts = sorted(rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["p"])
    n = sum(r["n"] for r in counts)
    left = max(1, int(n * val_frac)) if n else 0
    cut = None
    for r in counts:
        if left <= r["n"]:
            cut = rows.filter(part == r["p"]).select("_key").orderBy("_key").limit(left).agg(F.max("_key")).first()[0]
            break
        left -= r["n"]
    split = F.when(F.col("_key") <= F.lit(cut), "val").otherwise("train") if cut is not None else F.lit("train")
    return out.withColumn("split", split).drop("_key")


def _row_key(df: DataFrame, key: str) -> list[str]:
    return [c for c in ("stream_id", key) if c in df.columns]


def ngram_precision(hyps: DataFrame, refs: DataFrame, n: int, group: str = "id") -> DataFrame:
    """Clipped n-gram precision of each hypothesis: best overlap with one of its references.

    ``hyps`` is (id, text), ``refs`` is (``group``, ref_id, text); hypotheses that share references have ``group`` as a
    column too, so that each reference is cut into n-grams once.
    """
    def grams(df: DataFrame, keys: list[str]) -> DataFrame:
        words = F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda x: x != "")
        rows = df.select(*keys, words.alias("w"))
        count = F.greatest(F.size("w") - (n - 1), F.lit(0))
        at = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        rows = rows.select(*keys, F.explode(F.transform(at, lambda i: F.array_join(F.slice("w", i, n), " "))).alias("gram"))
        return rows.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("c"))

    h = grams(hyps, list(dict.fromkeys(["id", group])))
    r = grams(refs, [group, "ref_id"]).withColumnRenamed("c", "rc")
    total = h.groupBy("id").agg(F.sum("c").alias("total"))
    match = h.join(r, [group, "gram"]).groupBy("id", "ref_id").agg(F.sum(F.least("c", "rc")).alias("m")).groupBy("id").agg(F.max("m").alias("m"))
    out = hyps.select("id").join(total, "id", "left").join(match, "id", "left")
    return out.select("id", F.when(F.coalesce("total", F.lit(0)) > 0, F.coalesce("m", F.lit(0)) / F.col("total")).otherwise(F.lit(0.0)).alias("precision"))
