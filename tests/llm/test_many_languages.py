"""More languages than any cap."""

import numpy as np
from pyspark.sql import functions as F

from pelagrid.llm import language


def test_every_label_is_learned(spark):
    draw = np.random.default_rng(1)
    names = [f"l{i:03}" for i in range(230)]
    rows = []
    for i, name in enumerate(names):
        letters = [chr(0x4E00 + 20 * i + k) for k in range(20)]
        # The last languages are the rarest.
        for _ in range(6 if i < 200 else 2):
            rows.append((len(rows), " ".join("".join(draw.choice(letters, 4)) for _ in range(30)), name))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True))
    assert model.languages == names
    # The idf of a feature in all rows: as many rows as have it are counted in all.
    assert model.idf.min() == 1.0
    right = {r["lang"] for r in language.identify(docs, model).where("lang = lang_pred").collect()}
    assert len(right & set(names[200:])) >= 29 and len(right) >= 225
