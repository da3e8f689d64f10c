"""Cluster names and display groups."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short names of acoustic classes, families whose class needs its name before it, labels that say little.
ABBREVIATIONS = {
    "reg": "reggae", "cou": "country", "blu": "blues", "met": "metal", "dis": "disco", "hip": "hip hop", "cla": "classical",
    "dan": "dance", "jaz": "jazz", "roc": "rock", "spe": "speech", "funksoulrnb": "funk soul rnb",
}
PREFIXED = ["mood_happy", "mood_sad", "mood_relaxed", "mood_party", "mood_electronic", "voice_instrumental", "timbre"]
GENERIC = ["tempo change", "danceable", "voice instrumental / voice", "voice instrumental / instrumental"]
UNNAMING = ["genre_tzanetakis", "genre_dortmund", "genre_rosamerica", "ismir04_rhythm", "moods_mirex", "tonal_atonal", "genre_electronic"]
MIXED, LEAST_DESCRIPTOR = "mixed vibe cluster", 0.15

# Ordered rules (group, any of these words, but none of those); the first that holds wins.
BY_NAME = [
    ("More Picks", [MIXED], []),
    ("Instrumental / Breakbeat", ["breakbeat", "soundtrack"], []),
    ("Jazz / Nujabes / Downtempo", ["cool jazz", "jazz rap", "boom bap", "nu jazz", "jazz /", "/ jazz"], []),
    ("Acoustic / Chill", ["singer songwriter"], []),
    ("Electronic / Dance", ["tech house", "bass house", "uk garage", "bassline", "drum and bass", "dnb", "dubstep", "techno", "trance", "electro house", "big beat"], []),
    ("Electronic / Dance", ["house"], ["rock"]),
    ("Rock / Indie", ["rock", "indie", "alternative", "punk", "grunge", "emo", "shoegaze", "slowcore", "indietronica"], ["hip hop", "r and b", "rap"]),
    ("Trap", ["trap", "thug rap", "southern hip hop"], []),
    ("R&B / Soul", ["r and b", "r b", "soul"], []),
    ("Melodic / Party Rap", ["rage rap", "melodic rap", "emo rap", "pluggnb", "plugg"], []),
    ("Rap / Hip-Hop", ["rap", "hip hop"], []),
]
BY_FEATURES = [
    ("Instrumental / Breakbeat", ["breakbeat", "soundtrack", "trip hop"], []),
    ("Jazz / Nujabes / Downtempo", ["jazz", "boom bap", "downtempo"], []),
    ("Acoustic / Chill", ["singer songwriter", "folk", "acoustic guitar"], []),
    ("Electronic / Dance", ["house", "techno", "dubstep", "drum and bass", "dnb", "uk garage", "trance", "electro"], []),
    ("Rock / Indie", ["rock", "indie", "alternative", "punk", "grunge", "britpop", "shoegaze", "slowcore"], []),
    ("R&B / Soul", ["r and b", "soul"], []),
    ("Trap", ["trap", "thug rap", "southern hip hop"], []),
    ("Melodic / Party Rap", ["rage rap", "melodic rap", "emo rap", "pluggnb"], []),
    ("Rap / Hip-Hop", ["rap", "hip hop"], []),
    ("Melodic / Party Rap", ["mood party", "danceable", "voice instrumental", "timbre / dark", "timbre / bright", "aggressive"], []),
]
BY_TERMS = [
    ("Instrumental / Breakbeat", ["breakbeat", "soundtrack"], []),
    ("Jazz / Nujabes / Downtempo", ["jazz rap", "boom bap", "nu jazz"], ["rage rap", "melodic rap", "emo rap", "pluggnb"]),
    ("Jazz", ["jazz", "bebop", "hard bop", "post bop", "big band", "dixieland", "swing"], ["rap", "hip hop"]),
    ("K-Pop / J-Pop", ["k-pop", "k pop", "kpop", "j-pop", "j pop", "jpop"], []),
    ("Hyperpop", ["hyperpop", "glitchcore", "digicore"], []),
    ("Vaporwave / Chillwave", ["vaporwave", "chillwave", "mallsoft", "future funk"], []),
    ("Bollywood / Indian", ["bollywood", "filmi", "hindi pop", "hindi rock", "indian classical", "indian pop", "indian folk", "telugu", "tamil", "punjabi pop", "desi pop"], []),
    ("Arabic", ["arabic", "arab pop", "khaleeji", "levantine", "egyptian pop"], []),
    ("Afrobeats", ["afrobeat", "amapiano", "afro pop", "afro fusion", "afro house"], []),
    ("Folk", ["folk"], []),
    ("Acoustic / Chill", ["singer songwriter"], []),
    ("Electronic / Dance", ["tech house", "bass house", "uk garage", "bassline", "drum and bass", "dnb", "dubstep", "techno", "trance", "electro house", "big beat", "idm", "electronic"], ["shoegaze", "dream pop", "bedroom pop", "indietronica", "lo-fi indie", "psychedelic"]),
    ("Electronic / Dance", ["house"], ["rock", "shoegaze", "dream pop", "bedroom pop", "indietronica", "lo-fi indie", "psychedelic"]),
    ("Latin", ["latin", "reggaeton", "bachata", "salsa", "merengue", "cumbia", "bolero", "mariachi", "regional mexican", "banda", "ranchera", "bossa nova", "musica mexicana", "corrido", "tropical"], []),
    ("Country", ["country", "americana", "bluegrass", "honky tonk"], ["rap", "hip hop"]),
    ("Dream Pop / Bedroom Pop", ["bedroom pop", "dream pop", "lo-fi indie"], []),
    ("Lo-fi", ["lo-fi", "lo fi", "lofi", "chillhop"], ["indie"]),
    ("Rock / Indie", ["rock", "indie", "alternative", "punk", "grunge", "emo", "shoegaze", "slowcore", "psychedelic", "britpop", "new wave"], ["hip hop", "r and b", "rap"]),
    ("Pop", ["pop rock", "art pop", "indie pop", "synth pop", "electropop"], []),
    ("Pop", ["pop"], ["hip hop", "rap"]),
    ("Trap", ["trap", "thug rap", "southern hip hop"], []),
    ("R&B / Soul", ["r and b", "soul"], []),
    ("Melodic / Party Rap", ["rage rap", "melodic rap", "emo rap", "pluggnb", "plugg"], []),
    ("Drill", ["drill"], []),
    ("Rap / Hip-Hop", ["rap", "hip hop"], []),
    ("Melodic / Party Rap", ["mood party", "danceable", "voice instrumental", "timbre", "aggressive"], []),
]


def routed(text: Column, rules: list[tuple[str, list[str], list[str]]], otherwise: Column) -> Column:
    """The group of the first rule that holds, as one chain of conditions."""
    has = lambda words: reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))
    chain = F
    for group, words, but in rules:
        chain = chain.when(has(words) & ~has(but) if but else has(words), F.lit(group))
    return chain.otherwise(otherwise)


def display_group(name: Column, pretty: Column) -> Column:
    """Group of a cluster by its name, else by its features' names (an array of text)."""
    text = F.lower(F.array_join(pretty, " "))
    return routed(F.lower(F.coalesce(name, F.lit(""))), BY_NAME, routed(text, BY_FEATURES, F.lit("More Picks")))


def term_group(terms: Column) -> Column:
    return routed(F.lower(terms), BY_TERMS, F.lit("More Picks"))


# Kinds of groups by the beginning of an id, and then by words in a label; the first that fits.
KEY_BY_ID = (("vibe-", "vibe"), ("era-", "era"), ("pop-", "popularity"), ("usage-", "usage"))
KEY_BY_LABEL = (
    ("jazz", ("jazz", "downtempo", "nujabes")), ("trap", ("trap",)), ("electronic", ("electronic", "dance")), ("dream", ("dream", "bedroom")), ("rock", ("rock", "indie")), ("rnb", ("r&b", "soul")),
    ("melodic", ("melodic", "party rap")), ("rap", ("rap", "hip-hop", "hip hop")), ("pop", ("pop",)), ("acoustic", ("acoustic", "chill")), ("instrumental", ("instrumental", "breakbeat")),
)


def group_key(id_: Column, label: Column) -> Column:
    """The kind of a suggested group, by its id or else its label; empty if nothing fits."""
    low, tests = F.lower(F.coalesce(label, F.lit(""))), [(F.coalesce(id_, F.lit("")).startswith(start), key) for start, key in KEY_BY_ID]
    for key, words in KEY_BY_LABEL:
        held = F.lit(False)
        for w in words:
            held = held | F.contains(low, F.lit(w))
        tests.append((held, key))
    chain = F
    for test, key in tests:
        chain = chain.when(test, F.lit(key))
    return chain.otherwise(F.lit(""))


def pretty_feature(feature: Column) -> Column:
    spaced = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    body = F.regexp_replace(feature, "^(tag|genre|meta)__", "")
    parts = F.filter(F.split(F.replace(F.replace(F.regexp_replace(feature, "^acoustic__", ""), F.lit("highlevel__"), F.lit("")), F.lit("__all__"), F.lit("__")), "__"), lambda p: p != "")
    last, family = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    known = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    last = F.coalesce(F.element_at(known, last), last)
    acoustic = F.when(family.isin(PREFIXED), F.concat(spaced(family), F.lit(" / "), spaced(last))).otherwise(spaced(last))
    return F.when(feature.startswith("acoustic__"), F.coalesce(acoustic, spaced(feature))).otherwise(spaced(body))


def names_well(feature: Column) -> Column:
    return feature.startswith("tag__") | feature.startswith("genre__") | (feature.startswith("acoustic__") & ~feature.rlike("|".join(UNNAMING)))


def generic(label: Column) -> Column:
    return label.isin(GENERIC) | label.startswith("timbre / ") | label.startswith("mood ")


def cluster_names(features: DataFrame, by: list[str]) -> DataFrame:
    """(by, name, n_features, top_score, mixed): up to two distinct labels, good naming features first; features(by, feature, score, rank)."""
    labelled = features.withColumn("label", pretty_feature(F.col("feature"))).withColumn("good", names_well(F.col("feature")))
    each = labelled.groupBy(*by, "label").agg(F.min(F.struct((~F.col("good")).alias("bad"), "rank")).alias("at"))
    two = each.groupBy(*by).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]), 1, 2).alias("labels"))
    facts = features.groupBy(*by).agg(F.count("*").alias("n_features"), F.max("score").alias("top_score"))
    weak = (F.col("top_score") < 0.20) & F.forall("labels", generic)
    name = F.when(weak | (F.size("labels") == 0), MIXED).otherwise(F.array_join("labels", " / "))
    return two.join(facts, by).select(*by, name.alias("name"), "n_features", "top_score", (name == MIXED).alias("mixed"))


def display_groups(clusters: DataFrame, by: list[str]) -> DataFrame:
    """Roll-up of clusters(by, display_group, cluster, name, size, sample_tracks, descriptors): members by size, first distinct samples and descriptors.

    descriptors: array<struct<label, score>>; blank ones and those below 0.15 are left out.
    """
    members = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("o"), "cluster", "name", "sample_tracks", "descriptors")))
    grouped = clusters.groupBy(*by, "display_group").agg(F.sum("size").alias("size"), members.alias("m"))
    column = lambda n: F.transform("m", lambda x: x[n])
    told = F.filter(F.flatten(column("descriptors")), lambda d: (F.coalesce(d["label"], F.lit("")) != "") & (d["score"] >= LEAST_DESCRIPTOR))
    return grouped.select(
        *by, "display_group", "size", column("cluster").alias("member_cluster_ids"), column("name").alias("member_cluster_names"),
        F.slice(F.array_distinct(F.transform(told, lambda d: d["label"])), 1, 10).alias("top_descriptors"), F.slice(F.array_distinct(F.flatten(column("sample_tracks"))), 1, 12).alias("sample_tracks"),
    )


def suffixed(clusters: DataFrame, playlist: str = "playlist_id") -> DataFrame:
    """(playlist, cluster, label): in a playlist, further clusters of a group are told apart by a term that isn't in its name and isn't used yet, else by a number.

    Greedy, over the few clusters of one playlist; clusters(playlist, cluster, display_group, size, terms).
    """

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "cluster"], ascending=[False, True])
        count, used, out = {}, set(), []
        for group, terms in zip(pdf["display_group"], pdf["terms"], strict=True):
            count[group] = count.get(group, 0) + 1
            if count[group] == 1:
                out.append(group)
                continue
            words = set(group.lower().replace("/", " ").split())
            term = next((t for t in terms if t not in used and not set(t.lower().split()) <= words), None)
            used.add(term)
            out.append(f"{group}: {term}" if term else f"{group} {count[group]}")
        return pdf[[playlist, "cluster"]].assign(label=out)

    kinds = dict(clusters.dtypes)
    return clusters.select(playlist, "cluster", "display_group", "size", "terms").groupBy(playlist).applyInPandas(label, f"{playlist} {kinds[playlist]}, cluster {kinds['cluster']}, label string")
