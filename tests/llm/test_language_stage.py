"""The language stage rejects texts of no learned language and keeps clean ones."""

import random

from caseloom.llm import language_id
from tests.llm import brute

FOREIGN = [
    "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί και φεύγει μακριά",
    "Быстрая коричневая лиса прыгает через ленивую собаку и убегает в лес",
    "敏捷的棕色狐狸跳过了懒狗然后跑进了森林里面去了",
    "Nopea ruskea kettu hyppää laiskan koiran yli ja juoksee metsään jossa se asuu",
]


def test_foreign_and_random_texts_go(spark):
    rng = random.Random(1)
    letters = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 10))) for _ in range(60))
    odd = [*FOREIGN, letters, " ".join(f"{rng.getrandbits(60):x}" for _ in range(40))]
    clean = spark.read.parquet(f"{brute.SF}/documents.parquet").select("doc_id", "text", "lang")
    added = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(odd)], clean.schema)
    kept = {r.doc_id for r in language_id.language_stage(clean.unionByName(added)).collect()}
    assert kept == {r.doc_id for r in clean.collect()}
