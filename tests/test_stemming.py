"""Italian stems: known pairs of the Snowball rules, odd words, use in cleaning."""

from pyspark.sql import functions as F

from tessella.functions.stemming import italian_stem, italian_stems
from tessella.operators import words

SAMPLE = {
    "abbandonata": "abbandon", "abbandonate": "abbandon", "abbandonati": "abbandon", "abbandonato": "abbandon", "abbandonava": "abbandon",
    "abbandonerà": "abbandon", "abbandoneranno": "abbandon", "abbandonerò": "abbandon", "abbandono": "abband", "abbandonò": "abbandon",
    "abbaruffato": "abbaruff", "abbassamento": "abbass", "abbassando": "abbass", "abbassandola": "abbass", "abbassandole": "abbass", "abbassare": "abbass",
    "abbassarono": "abbass", "abbassarsi": "abbass", "abbassassero": "abbass", "abbassato": "abbass", "abbassava": "abbass", "abbassi": "abbass", "abbasso": "abbass",
    "abbastanza": "abbast", "abbatté": "abbatt", "abbattendo": "abbatt", "abbattere": "abbatt", "abbattersi": "abbatt", "abbattesse": "abbattess",
    "pronto": "pront", "pronuncerà": "pronunc", "pronuncia": "pronunc", "pronunciamento": "pronunc", "pronunciare": "pronunc", "pronunciarsi": "pronunc",
    "pronunciata": "pronunc", "pronunziato": "pronunz", "propaganda": "propagand", "propagare": "propag", "propagarla": "propag", "propensione": "propension",
    "propensioni": "propension", "propiziatorio": "propiziator", "propongono": "propong", "proporzioni": "proporzion", "propose": "propos", "proposito": "propos",
    "proposizione": "proposizion", "proposta": "propost", "proposto": "propost", "proprietà": "propriet", "proprio": "propr",
    "prosciolto": "prosciolt", "prosegue": "prosegu", "proseguendo": "prosegu", "prosperamente": "prosper", "prosperità": "prosper",
}


def test_sample(spark):
    rows = spark.createDataFrame(list(SAMPLE.items()), "word string, stem string").repartition(2)
    wrong = rows.select("word", "stem", italian_stem(F.col("word")).alias("got")).where("got <> stem").collect()
    assert not wrong, wrong


def test_odd_words(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a",), ("è",), ("gli",), ("日本",)], "word string")
    got = [r["s"] for r in rows.select(italian_stem(F.col("word")).alias("s")).collect()]
    assert got == [None, "", "a", "è", "gli", "日本"]


def test_as_stem_of_cleaning(spark):
    rows = spark.createDataFrame([("abbandonata e propagare",)], "t string")
    assert rows.select(words.clean_tokens("t", stop_words=("e",), stem=italian_stems).alias("w")).first()["w"] == ["abbandon", "propag"]
