"""Whole layers: what is written where, and what each write reports."""

from __future__ import annotations

from typing import Any, Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from prosa.operators import bronze as B
from prosa.operators import competition, conversations, leads, personas, segments, sellers, sentiment, silver, timing
from prosa.operators import gold as G
from prosa.params import CANONICAL, Profile
from prosa.sources import skipping
from prosa.sources.tables import KEY, Tables, read_source

#: Above so many incoming ids, all ids are grouped; up to here they are joined, and Spark may send them to every task.
MANY = 50_000


def ingest(tables: Tables, source_path: str, mode: str = "auto", profile: Profile = CANONICAL,
           schema=None) -> dict[str, Any]:
    """Source file to Bronze: ``full`` replaces, ``incremental`` appends what is new, ``auto``
    picks incremental when Bronze exists. Rows written are counted during the write."""
    if mode not in ("auto", "full", "incremental"):
        raise ValueError(f"mode {mode!r}")
    raw = B.require_valid(read_source(tables.spark, source_path, schema), profile)
    rows_read = raw.count()
    exists = tables.exists("bronze")
    mode_used = mode if mode != "auto" else "incremental" if exists else "full"

    fresh = raw if profile.name == "notebook" else B.cast_timestamp(raw)
    if mode_used == "incremental" and exists:
        fresh, release = compared(tables, fresh, profile)
    incremental = mode_used == "incremental"
    if incremental and exists:
        # Compared once, used twice: to see whether there is anything, and to write it.
        fresh = fresh.persist()
        if fresh.isEmpty():
            fresh.unpersist()
            release()
            return {"rows_read": rows_read, "rows_written": 0, "mode": "incremental", "status": "no_new_data"}
    typed = B.stamp(B.parse_metadata(fresh, profile), source_path)
    seen = Observation("ingest")
    observed = typed.observe(seen, F.count(F.lit(1)).alias("rows"))
    version = tables.write(observed, "bronze", "append" if incremental else "overwrite")
    fresh.unpersist()
    if incremental and exists:
        release()
    return {
        "rows_read": rows_read, "rows_written": seen.get["rows"], "total_rows": tables.count("bronze"),
        "mode": mode_used, "version": version, "status": "success",
    }


def unheld(tables: Tables, incoming: DataFrame, profile: Profile = CANONICAL, leave: tuple[str, int] | None = None) -> DataFrame:
    """Incoming messages that Bronze doesn't hold; ``leave`` is a batch of Bronze to leave out of the comparison.

    Only batches that may hold one of the ids are compared. In the canonical profile these are the ids of messages not
    later than all of Bronze: a load of later messages only reads none of it.
    """
    if profile.name == "notebook":
        return B.unseen_ids(incoming, tables.possible("bronze", incoming.select("message_id"), leave))
    if tables.fmt == "delta" or not tables.batches("bronze"):
        return B.new_rows(incoming, tables.read("bronze"))
    late, latest = earlier(tables, incoming, leave)
    return B.new_rows(incoming, tables.possible("bronze", late.select("message_id"), leave), latest)


def earlier(tables: Tables, incoming: DataFrame, leave: tuple[str, int] | None) -> tuple[DataFrame, Column]:
    """The incoming messages that aren't later than all of Bronze, and its latest time."""
    latest = F.timestamp_micros(F.lit(skipping.newest(tables, "bronze", "timestamp", leave)).cast("long"))
    return incoming.where((F.col("timestamp") <= latest) | F.col("timestamp").isNull() | latest.isNull()), latest


def compared(tables: Tables, incoming: DataFrame, profile: Profile = CANONICAL,
             leave: tuple[str, int] | None = None) -> tuple[DataFrame, Callable[[], None]]:
    """What :func:`unheld` gives, for a load, and what to call when it is written.

    Ids are compared first and alone. The messages then meet the shorter list, that of the ids held or that of the ids
    not held, whose size Spark knows by then: where nearly all or nearly none are held, messages aren't shuffled.
    """
    if profile.name == "notebook" or tables.fmt == "delta" or not tables.batches("bronze"):
        return unheld(tables, incoming, profile, leave), lambda: None
    late, latest = earlier(tables, incoming, leave)
    many = late.select("message_id").limit(MANY + 1).count() > MANY
    ids = B.compared_ids(late, tables.possible("bronze", late.select("message_id"), leave), many).persist()
    total, known = ids.agg(F.count(F.lit(1)), F.count_if("_held")).first()
    held = 2 * known <= total
    shorter = ids.where(F.col("_held") if held else ~F.col("_held")).select("message_id").persist()
    listed = shorter.count()
    ids.unpersist()
    if not held and not listed:
        # Nothing is new but what is later or has no id: two columns tell whether there is any.
        rest = (F.col("timestamp") > latest) | F.col("message_id").isNull()
        incoming = incoming.where(F.lit(False) if incoming.where(rest).isEmpty() else rest)
    return B.rows_by_ids(incoming, shorter, held, latest), lambda: shorter.unpersist()


def build_silver(tables: Tables, profile: Profile = CANONICAL) -> dict[str, Any]:
    """Bronze to both Silver tables. Messages are written once; conversations aggregate what was
    written, so the text patterns run once. Gold no longer follows from Silver then: a refresh builds it anew."""
    source = tables.read("bronze")
    tables.drop(gold_state(tables))
    tables.overwrite(silver.silver_messages(source, profile), "silver_messages")
    messages = tables.read("silver_messages")
    tables.overwrite(conversations.silver_conversations(messages, profile), "silver_conversations")
    stats = {**silver.cleaning_stats(source, messages).first().asDict()}
    if profile.name != "notebook":
        stats |= silver.extraction_stats(messages).first().asDict()
        stats |= conversations.conversation_stats(tables.read("silver_conversations")).first().asDict()
    return stats


def gold_frames(convs: DataFrame, profile: Profile = CANONICAL) -> dict[str, DataFrame]:
    """All Gold tables as frames over one conversations table."""
    frames = {
        "gold_sentiment": sentiment.gold_sentiment(convs, profile),
        "gold_personas": personas.gold_personas(convs, profile),
        "gold_segmentation": segments.gold_segmentation(convs, profile),
        "gold_analytics": leads.gold_analytics(convs, profile),
        "gold_vendor": sellers.seller_metrics(convs, profile),
    }
    if profile.name != "notebook":
        scored = leads.with_lead_score(convs, profile)
        frames |= {
            "gold/lead_scoring": leads.gold_score_parts(convs, profile),
            "gold/funil_conversao": leads.funnel(convs),
            "gold/performance_campanha": leads.campaign_performance(scored),
            "gold/analise_temporal": timing.daily_volume(convs),
            "gold/analise_concorrencia": competition.loss_by_competitor(convs),
        }
    return frames


def gold_state(tables: Tables) -> str:
    """Where the sums behind the grouped Gold tables are."""
    return f"{tables.root}/gold_state"


def write_grouped(tables: Tables, profile: Profile = CANONICAL) -> dict[str, int]:
    """The grouped Gold tables anew from their sums: a row for each seller, campaign, day and so on."""
    sums = tables.read(gold_state(tables))
    sums = G.summed(sums) if len(tables.batches(gold_state(tables))) > 1 else sums

    def write(name: str) -> int:
        tables.overwrite(G.cut(sums, name, profile), tables.place(name))
        return tables.count(tables.place(name))

    return {name: write(name) for name in G.grouped_tables(profile)}


def gold_rules(rows: DataFrame) -> dict[str, Column]:
    """What no row for Gold may have in a text: a CPF or an e-mail address. The conversation's own id is not looked at."""
    return silver.leak_rules(rows, ("cpf", "email"), leave=(KEY,))


def sum_rules(sums: DataFrame) -> dict[str, Column]:
    """The same for the groups' keys. Sums that take something back may have it: it goes."""
    return {kind: rule & (F.col("n") >= 0) for kind, rule in gold_rules(sums).items()}


def build_gold(tables: Tables, profile: Profile = CANONICAL, convs: DataFrame | None = None, grouped: bool = True,
               guard: bool = True) -> dict[str, int]:
    """Write all Gold tables from Silver conversations, which are read twice; rows per table.

    The tables with a row for each conversation are written in one job. The grouped ones are cut from one table of sums, which
    is written last: where it is, Gold is complete. Column selection keeps personal data out: no Gold table has a message
    text, phone, name, plate or hash. What remains is counted during the write, and ``BrokenRules`` is raised before any table
    is replaced if a text has a CPF or an address; ``guard=False`` leaves that out.
    """
    convs = tables.read("silver_conversations") if convs is None else convs
    state = gold_state(tables)
    tables.drop(state)
    columns = G.row_columns(profile)
    tagged = G.row_tables(convs, profile)
    tables.write_many(tagged, G.TABLE, columns, rules=gold_rules(tagged) if guard else None)
    rows = dict.fromkeys(columns, tables.count(tables.place("gold_sentiment")))  # one for each conversation
    sums = G.summed(G.contributions(convs, profile))
    tables.overwrite(sums, state, rules=sum_rules(sums) if guard else None)
    return rows | (write_grouped(tables, profile) if grouped else {})


def one_plan(source: DataFrame, profile: Profile = CANONICAL) -> DataFrame:
    """Source messages to conversations without writing anything in between."""
    typed = B.to_bronze(source, "memory", profile)
    return conversations.silver_conversations(silver.silver_messages(typed, profile), profile)
