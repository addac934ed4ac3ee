"""The curated catalogue: which public-domain books serve which topic, and their retrieval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlake.functions import text as T
from graphlake.sources import http

# fixed values: catalogue number, title, author
BOOKS = [
    (874, "A History of Aeronautics", "Evelyn Charles Vivian"),
    (34815, "Jane's All the World's Aircraft, 1913", "Fred T. Jane"),
    (60277, "Aerial Navigation", "Albert Francis Zahm"),
    (47981, "Langley Memoir on Mechanical Flight, Parts I and II", "S. P. Langley"),
    (27557, "Learning to Fly: A Practical Manual for Beginners", "Claude Grahame-White"),
    (25420, "The Early History of the Airplane", "Orville Wright"),
    (907, "Flying Machines: Construction and Operation", "William J. Jackman"),
    (793, "Aeroplanes and Dirigibles of War", "Frederick Arthur Ambrose Talbot"),
    (66702, "Wireless Telegraphy and Telephony Simply Explained", "Alfred Powell Morgan"),
    (40268, "Significant Achievements in Space Bioscience 1958-1964", "NASA"),
    (57973, "The Hurricane Hunters", "Ivan Ray Tannehill"),
    (32570, "Zeppelin: The Story of a Great Achievement", "Harry Vissering"),
    (73142, '"We"', "Charles A. Lindbergh"),
    (38187, "Aviation Engines: Design—Construction—Operation and Repair", "Victor Wilfred Page"),
]
# fixed values: topic, catalogue numbers by relevance
TOPICS = [
    ("flight_rules", [27557, 73142]),
    ("flight_operations", [38187, 57973]),
    ("ground_instrumentation", [34815, 60277]),
    ("trajectory_guidance_propulsion", [47981, 38187]),
    ("data_systems", [66702]),
    ("guidance_navigation_control", [25420, 60277]),
    ("electrical", [66702, 907]),
    ("mechanical", [793, 907]),
    ("communications", [66702]),
    ("aeronautical", [874, 34815, 32570]),
    ("space_environment", [40268]),
    ("post_landing_life_support", [40268]),
    ("thermal", [38187]),
]


# fixed values: where a text may lie, in the order to try
URLS = ["https://www.gutenberg.org/cache/epub/{id}/pg{id}.txt", "https://www.gutenberg.org/files/{id}/{id}-0.txt", "https://www.gutenberg.org/files/{id}/{id}.txt"]


def catalog(spark: SparkSession) -> DataFrame:
    """(topic, position, gutenberg_id, title, author)."""
    topics = spark.createDataFrame(TOPICS, "topic string, ids array<int>").select("topic", F.posexplode("ids").alias("position", "gutenberg_id"))
    books = spark.createDataFrame(BOOKS, "gutenberg_id int, title string, author string")
    return topics.join(F.broadcast(books), "gutenberg_id").select("topic", "position", "gutenberg_id", "title", "author")


def fetch_topic(listed: DataFrame, texts: DataFrame, topic: str | None = None, max_books: int = 1, least_chars: int = 2000) -> DataFrame:
    """The first books of each topic (or one), of those whose text (gutenberg_id, text) is there and long enough; an unknown topic gives none."""
    wanted = listed.where(F.col("topic") == topic) if topic else listed
    first = wanted.withColumn("__r", F.row_number().over(Window.partitionBy("topic").orderBy("position"))).where(F.col("__r") <= max_books)
    found = first.join(texts, "gutenberg_id").where(F.length("text") >= least_chars)
    name = F.concat(F.col("gutenberg_id").cast("string"), F.lit("_"), T.slugify(F.col("title")), F.lit(".txt"))
    return found.select("topic", "gutenberg_id", "title", "author", name.alias("file_name"), "text")


def topics_without_hits(listed: DataFrame, fetched: DataFrame) -> DataFrame:
    return listed.select("topic").distinct().join(fetched.select("topic").distinct(), "topic", "left_anti")


def download(wanted: DataFrame, urls: list[str] | None = None, get: Callable[[str], tuple[int, bytes]] = http.get) -> DataFrame:
    """(gutenberg_id, text) by the first url pattern that answers 200 with content; clusters that reach the net in their own way give their own ``get``."""
    urls = URLS if urls is None else urls

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for g in b["gutenberg_id"]:
                for url in urls:
                    status, body = get(url.format(id=g))
                    if status == 200 and body:
                        rows.append((g, body.decode("utf-8", "ignore")))
                        break
            yield pd.DataFrame(rows, columns=["gutenberg_id", "text"])

    return wanted.select("gutenberg_id").distinct().mapInPandas(run, "gutenberg_id int, text string")
