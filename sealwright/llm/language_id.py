"""Language by compression: the language whose dictionary makes a text smallest; narrow margins are rejected.

For each language a raw-content zstandard dictionary is cut from a bounded sample of labelled texts. A text is
cleaned, cut into chunks of CHUNK_BYTES (all of it; a long text would else teach the compressor its own words), and
each chunk is compressed with every dictionary. The margin is the part by which the best sum is below the second.
Sizes are whole bytes, so a text whose best sum isn't below the second by a sure number of bytes and a sure part (most of
the short ones, and those that repeat a few words) rides behind carriers as well: pieces of the language's own sample,
whose size without the text is subtracted; over the carriers, the means differ by parts of a byte. The rule is the same
for texts of all sizes, and each language has as many carriers, whatever the size of its sample.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import letters, lists

#: The bound of what is learned from: so many texts a language, so many characters of each, so many bytes in all.
SAMPLE_TEXTS, SAMPLE_CHARS, DICTIONARY_BYTES = 96, 1500, 96 << 10
CHUNK_BYTES = 1024
#: Carriers of a language, and the bytes of each (less for a sample that is shorter than twice that).
CARRIERS, CARRIER_BYTES = 16, 1024
#: A best sum that is below the second by this part and by so many bytes is taken without carriers.
SURE_MARGIN, SURE_BYTES = 0.03, 16
#: So many languages are learned, those with the most labelled texts; labels that few texts have can't crowd the driver.
LANGUAGES = 256
#: A text is rejected whose best language isn't better than the next by this part.
MIN_MARGIN = 0.0005
UNKNOWN = "und"
RESULT = "lang_pred string, score double, margin double, rejected boolean"


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; such documents are never learned from. False for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """language -> raw dictionary, from at most SAMPLE_TEXTS labelled texts a language that aren't held out.

    The sample is each language's first texts by a hash; each task keeps no more than that before the shuffle. What
    reaches the driver is at most LANGUAGES * SAMPLE_TEXTS * SAMPLE_CHARS characters.
    """
    sample = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    sample = sample.filter(F.col("lang").isin([r["lang"] for r in most.collect()]))
    sample = sample.select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"), F.xxhash64(F.col("doc_id").cast("string"), F.length("text")).alias("key"))
    order = Window.partitionBy("lang").orderBy("key", "text")
    sample = sample.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE_TEXTS)
    texts: dict[str, list[str]] = {}
    for lang, _, text in sorted(sample.select("lang", "rank", letters(F.col("text")).alias("text")).collect()):
        if text.strip():
            texts.setdefault(lang, []).append(text.strip())
    return {lang: " ".join(x).encode()[-DICTIONARY_BYTES:] for lang, x in sorted(texts.items())}


def carriers_of(sample: bytes) -> tuple[list[bytes], bytes]:
    """CARRIERS pieces of the first part of a sample, which overlap if that is short, and the rest of the sample."""
    room = min(CARRIERS * CARRIER_BYTES, len(sample) // 2)
    size = min(CARRIER_BYTES, room)
    starts = [i * (room - size) // (CARRIERS - 1) for i in range(CARRIERS)]
    return [sample[i : i + size] for i in starts], sample[room:]


class Classifier:
    """Sizes of cleaned texts under each language's dictionary."""

    def __init__(self, learned: dict[str, bytes]):
        import zstandard as z

        def compressor(content: bytes, level: int, size: int):
            p = z.ZstdCompressionParameters.from_level(level, source_size=size, dict_size=len(content), write_content_size=0, write_dict_id=0)
            return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=p).compress

        self.langs = sorted(learned)
        self.long = [compressor(learned[x], 3, CHUNK_BYTES) for x in self.langs]
        self.carried = []
        for x in self.langs:
            carriers, rest = carriers_of(learned[x])
            compress = compressor(rest, 12, CARRIER_BYTES + CHUNK_BYTES)
            self.carried.append((compress, carriers, sum(len(compress(c)) for c in carriers)))

    def sizes(self, text: bytes) -> list[int]:
        chunks = [text[i : i + CHUNK_BYTES] for i in range(0, len(text), CHUNK_BYTES)]
        return [sum([len(compress(x)) for x in chunks]) for compress in self.long]

    def carried_sizes(self, text: bytes) -> list[int]:
        return [sum([len(compress(c + b" " + text)) for c in carriers]) - alone for compress, carriers, alone in self.carried]

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected) of a cleaned text; ties go to the first language by name."""
        raw = (text or "").strip().encode()
        if not raw or not self.langs:
            return UNKNOWN, 0.0, 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, 1.0, False
        (best, lang), (second, _) = sorted(zip(self.sizes(raw), self.langs))[:2]
        margin = 1 - best / second
        if margin < SURE_MARGIN or second - best < SURE_BYTES:
            chunks = [raw[i : i + CHUNK_BYTES] for i in range(0, len(raw), CHUNK_BYTES)]
            sizes = map(sum, zip(*map(self.carried_sizes, chunks)))
            (best, lang), (second, _) = sorted(zip(sizes, self.langs))[:2]
            margin = min(1.0, (second - best) / (CARRIERS * len(raw)))
        return lang, margin / (margin + 0.02), margin, margin < MIN_MARGIN


def predicted(text: Column, learned: dict[str, bytes]) -> Column:
    """A struct column (RESULT) of the text column. Null texts, and texts without a letter, are UNKNOWN and rejected."""
    @F.arrow_udf(RESULT)
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return predictions(texts, learned)

    return predict(letters(text))


def predictions(texts: Iterable[pa.Array], learned: dict[str, bytes]) -> Iterator[pa.Array]:
    """Structs RESULT of cleaned texts. A batch is a task's whole share, so its parts are worked off one by one."""
    classifier = Classifier(learned)
    fields = {"lang_pred": pa.string(), "score": pa.float64(), "margin": pa.float64(), "rejected": pa.bool_()}
    for part in lists(texts):
        columns = zip(*map(classifier.predict, part))
        yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values())], list(fields))


def identify(docs: DataFrame, learned: dict[str, bytes] | None = None) -> DataFrame:
    """docs (its columns named as those of RESULT are replaced) with the columns of RESULT; only the text is used."""
    learned = dictionaries(docs) if learned is None else learned
    names = [x.split()[0] for x in RESULT.split(", ")]
    kept = [c for c in docs.columns if c not in names]
    return docs.select(*kept, predicted(F.col("text"), learned).alias("__p")).select(*kept, *[F.col(f"__p.{n}").alias(n) for n in names])
