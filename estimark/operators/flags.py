"""Flags from texts: bait, corporate lets, auctions, misplaced addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from estimark.functions.scalars import any_of

# Fixed values.
FOREIGN = ["albania", "albanian", "tirana", "durres", "saranda", "vlora", "vlore", "dubai", "emirati arabi", "uae", "abu dhabi", "montenegro", "podgorica", "budva", "turchia", "turkey", "istanbul", "antalya",
           "portogallo", "portugal", "lisbona", "porto", "grecia", "greece", "atene", "athens", "creta", "croazia", "croatia", "zagabria", "dubrovnik", "marocco", "morocco", "marrakech", "casablanca",
           "shop like a billionaire", "invest abroad", "acquista all'estero", "investi all'estero", "resort & residence", "luxury resort abroad"]
SEASIDE = ["spiaggia privata", "marina privata", "vista mare", "fronte mare", "sul mare", "costa mare"]
COASTAL = ["napoli", "la_maddalena"]
AGENCIES = ["spacest", "spacest.com", "roomless", "milano monolocali", "dovevivo", "homy", "homy.it", "serviced apartment", "corporate housing", "short let", "short stay", "temporary milano", "affitti brevi", "milano short stay",
            "urban campus", "the social hub", "aparto", "camplus", "collegium", "milano studio rent", "milano transfer", "milano luxury", "tempoaffitti", "safestays", "housinganywhere", "the best rent"]
SIGNALS = ["minimo mesi", "massimo mesi", "medium term", "medium-term", "short term", "short-term", "corporate", "serviced", "all inclusive", "all-inclusive", "utenze incluse", "wifi incluso", "mensile", "monthly stay",
           "business travelers", "digital nomad", "minimo 1 mese", "da 1 mese", "temporary"]
AUCTION = r"(?i)\basta\b|\baste\b|all['’]?\s*asta|in\s+asta|asta\s+giudiziar|vendita\s+giudiziar|procedura\s+esecutiv|fallimentar|concordato\s+preventiv|pignoramento"
BARE_OWNERSHIP = r"(?i)nuda\s*propriet|usufrutto"
DISTANCE = r"a\s+(?:solo|soli)?\s*(\d+)[\s,.]?\d*\s*km(?:\s+(?:ca\.?|circa))?\s+da"


def shouting(title: Column, foreign: list[str] | None = None) -> Column:
    """More than half of the words of over two letters in capitals, in four words or more."""
    words = F.filter(F.split(title, r"\s+"), lambda w: w != "")
    long = F.filter(words, lambda w: F.length(w) > 2)
    caps = F.filter(long, lambda w: (F.upper(w) == w) & (F.lower(w) != w))
    return F.coalesce((F.size(words) >= 4) & (F.size(long) > 0) & (F.size(caps) * 2 > F.size(long)), F.lit(False))


def bait(title: Column, description: Column, city: Column, foreign: list[str] = FOREIGN, seaside: list[str] = SEASIDE) -> Column:
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(description, F.lit("")), 1, 1000)))
    inland = ~F.coalesce(F.lower(city), F.lit("milano")).isin(COASTAL)
    return any_of(text, foreign) | (inland & any_of(text, seaside)) | shouting(title)


def corporate(listing_id: Column, agency: Column, override_ids: list[str] | None = None, agencies: list[str] = AGENCIES) -> Column:
    hit = any_of(F.trim(F.lower(F.coalesce(agency, F.lit("")))), agencies)
    return hit | F.coalesce(listing_id.isin(override_ids), F.lit(False)) if override_ids else hit


def signals(text: Column, phrases: list[str] = SIGNALS, least: int = 2) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: low.contains(p))) >= least


def auction_or_bare(text: Column) -> tuple[Column, Column]:
    return F.coalesce(text.rlike(AUCTION), F.lit(False)), F.coalesce(text.rlike(BARE_OWNERSHIP), F.lit(False))


def misplaced(description: Column, comuni: list[str]) -> Column:
    """Why a description gives away another town: its name with the province, a distance of
    three kilometres or more, or its name in the opening; null if it doesn't."""
    low = F.lower(F.substring(description, 1, 1500))
    head = F.substring(low, 1, 300)
    marks = [f"{{}} ({p})" for p in ("mi", "rm", "na")] + ["{}(mi)"] + [f"{{}}, {p}" for p in ("mi", "rm", "na")]
    km = F.nullif(F.regexp_extract(low, DISTANCE, 1), F.lit("")).try_cast("int")
    out = F
    for town in sorted(comuni):
        out = out.when(any_of(low, [m.format(town) for m in marks]), F.lit(f"province:{town}"))
    out = out.when(km >= 3, F.concat(F.lit("distance:"), km.cast("string")))
    for town in sorted(comuni):
        out = out.when(head.contains(f" {town} ") | head.startswith(f"{town} "), F.lit(f"opening:{town}"))
    return out.otherwise(F.lit(None))
