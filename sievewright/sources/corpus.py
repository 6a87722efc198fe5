"""A synthetic source corpus with its answer key, as native columns: plain arithmetic draws, so any engine can recount it.

draw(id, i, m) = (((id + 1) * 7919 + i * 104729 + seed) * 48271 mod (2^31 - 1)) mod m. A file is untouched where
draw(id, 0, 100) < untouched; else it has a header and 1 + draw(id, 1, 4) parts, part i by the weights over draw(id, i + 2, 102).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED, UNTOUCHED, MODULUS = 20240914, 30, 2**31 - 1
NOUNS = ["badge", "cargo", "depot", "fleet", "guest", "ledger", "meter", "order", "parcel", "ticket", "voucher", "wallet"]
#: Weight of each part, and how many sites of each shape it holds.
PARTS = {
    "mechanical_call": (44, {"mechanical_call": 1}),
    "mechanical_redirect": (10, {"mechanical_redirect": 1}),
    "mechanical_session": (12, {"mechanical_session": 1}),
    "ambiguous_timeout": (9, {"ambiguous_timeout": 1}),
    "ambiguous_retry": (9, {"mechanical_call": 1, "ambiguous_retry": 2}),
    "ambiguous_status": (10, {"mechanical_call": 1, "ambiguous_status": 1}),
    "ambiguous_timeout_interactive": (8, {"ambiguous_timeout": 1}),
}
SHAPES = ["mechanical_call", "mechanical_redirect", "mechanical_session", "ambiguous_timeout", "ambiguous_retry", "ambiguous_status"]
WHOLE = sum(w for w, _ in PARTS.values())
#: Fixed: parts of a file at most.
MOST = 4

HEADER = '''"""Client of the {noun} service."""

import logging

import requests

BASE = "https://{noun}.example/v2"
log = logging.getLogger("{noun}")
'''
PLAIN = '''"""Sums over {noun} rows; nothing here leaves the process."""


def total(rows):
    """Adds up what each row holds."""
    return sum(row["amount"] for row in rows)


def largest(rows):
    return max(rows, key=lambda row: row["amount"], default=None)
'''
TEXTS = {
    "mechanical_call": '''

def read_{noun}_{n}(key):
    """The {noun} of this key, as the service stores it."""
    url = f"{BASE}/items/{key}"
    log.debug("reading %s", url)
    response = requests.get(url, timeout=5)
    response.raise_for_status()
    found = response.json()
    return {"key": key, "found": found}
''',
    "mechanical_redirect": '''

def resolve_{noun}_{n}(short):
    """Where a short link of a {noun} leads."""
    url = f"{BASE}/short/{short}"
    response = requests.get(url, allow_redirects=True, timeout=5)
    response.raise_for_status()
    return response.url
''',
    "mechanical_session": '''

def walk_{noun}_{n}(pages):
    """All pages of {noun} rows over one connection."""
    rows = []
    with requests.Session() as session:
        for page in range(pages):
            answer = session.get(f"{BASE}/pages/{page}", timeout=5)
            rows.extend(answer.json())
    return rows
''',
    "ambiguous_timeout": '''

def nightly_{noun}_export_{n}(day, target):
    """Writes everything a day brought to the target; runs after closing time."""
    url = f"{BASE}/dump"
    wanted = {"day": day.isoformat(), "format": "lines"}
    log.info("dump of %s", day)
    seen = 0
    kept = 0
    answer = requests.get(url, params=wanted)
    answer.raise_for_status()
    for line in answer.iter_lines():
        seen += 1
        if line:
            target.write(line)
            kept += 1
    log.info("%s of %s lines", kept, seen)
    return kept
''',
    "ambiguous_retry": '''

def push_{noun}_{n}(rows, attempts=3):
    """Sends rows; a lost connection is tried again."""
    url = f"{BASE}/rows"
    body = [dict(row) for row in rows]
    log.info("%s rows to send", len(body))
    for attempt in range(attempts):
        try:
            requests.post(url, json=body, timeout=10)
            return True
        except requests.exceptions.ConnectionError:
            log.warning("no connection, attempt %s", attempt)
        except requests.exceptions.Timeout:
            log.warning("too slow, attempt %s", attempt)
    log.error("gave up on %s rows", len(body))
    return False
''',
    "ambiguous_status": '''

def load_{noun}_{n}(key):
    """The {noun} of this key, or nothing where the service refuses."""
    url = f"{BASE}/items/{key}"
    log.debug("loading %s", url)
    answer = None
    try:
        answer = requests.get(url, timeout=5)
        answer.raise_for_status()
    except requests.exceptions.HTTPError as error:
        log.error("refused: %s", error)
        return None
    found = answer.json()
    found["key"] = key
    return found
''',
    "ambiguous_timeout_interactive": '''

def show_{noun}_{n}(key, view):
    """What the page of one {noun} needs; somebody waits for it."""
    url = f"{BASE}/items/{key}"
    fields = ["name", "state", "owner"]
    view.title = f"{key}"
    view.rows = []
    log.debug("showing %s", key)
    answer = requests.get(url, params={"fields": ",".join(fields)})
    answer.raise_for_status()
    found = answer.json()
    for field in fields:
        view.rows.append(found.get(field))
    view.ready = True
    log.debug("shown %s", key)
    return view
''',
}


def draw(i: int, most: int, seed: int = SEED) -> str:
    return f"((id + 1) * 7919 + {i} * 104729 + {seed}) * 48271 % {MODULUS} % {most}"


def corpus(ids: DataFrame, seed: int = SEED, untouched: int = UNTOUCHED) -> DataFrame:
    """ids (id, unique): file_ord, path, text and the answer key, shapes: how many sites of each shape the text holds. All
    texts that a part can have stand in constant arrays, so that a file's are looked up and not filled in again. Arrays are
    one literal and expressions one string, as the driver makes columns one by one."""
    of = lambda values, at: F.get(F.split(F.lit("\0".join(values)), "\0"), F.expr(at))
    filled = lambda text, noun, n=0: text.replace("{noun}", noun).replace("{n}", str(n))
    numbers = lambda values: f"array({', '.join(map(str, values))})"
    by_roll = numbers(p for p, (weight, _) in enumerate(PARTS.values()) for _ in range(weight))
    rows = ids.selectExpr("cast(id as long) AS id")
    rows = rows.selectExpr("id", f"cast({draw(9, len(NOUNS), seed)} as int) AS noun", f"CASE WHEN {draw(0, 100, seed)} < {untouched} THEN 0 ELSE cast({draw(1, MOST, seed)} as int) + 1 END AS n")
    rows = rows.selectExpr("id", "noun", "n", *(f"CASE WHEN n > {i} THEN get({by_roll}, cast({draw(i + 2, WHOLE, seed)} as int)) END AS part{i}" for i in range(MOST)))
    body = [F.coalesce(of([filled(t, x, i) for x in NOUNS for t in TEXTS.values()], f"noun * {len(TEXTS)} + part{i}"), F.lit("")) for i in range(MOST)]
    text = F.when(F.expr("n = 0"), of([filled(PLAIN, x) for x in NOUNS], "noun")).otherwise(F.concat(of([filled(HEADER, x) for x in NOUNS], "noun"), *body))
    held = lambda shape: " + ".join(f"coalesce(get({numbers(h.get(shape, 0) for _, h in PARTS.values())}, part{i}), 0)" for i in range(MOST))
    key = F.expr(f"map_filter(map({', '.join(f'{shape!r}, {held(shape)}' for shape in SHAPES)}), (shape, n) -> n > 0)")
    return rows.select(F.col("id").alias("file_ord"), F.concat(F.lit("svc/"), of(NOUNS, "noun"), F.lit("/client_"), F.expr("cast(id as string)"), F.lit(".py")).alias("path"), text.alias("text"), key.alias("shapes"))


def built(spark: SparkSession, n: int = 120, seed: int = SEED, untouched: int = UNTOUCHED) -> DataFrame:
    return corpus(spark.range(n), seed, untouched)


def stats(files: DataFrame) -> DataFrame:
    """One row of what the answer key holds."""
    each = lambda mechanical: F.coalesce(F.sum(F.aggregate(F.map_values(F.map_filter("shapes", lambda s, _: s.startswith("mechanical") == mechanical)), F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0))
    open_ = F.exists(F.map_keys("shapes"), lambda s: ~s.startswith("mechanical"))
    out = files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.size("shapes") > 0).alias("touched"), F.count_if(open_).alias("needing_model"), each(True).alias("mechanical"), each(False).alias("ambiguous"))
    return out.withColumn("sites", F.col("mechanical") + F.col("ambiguous"))
