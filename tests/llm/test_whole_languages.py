"""The fitting sample of the language model holds every language."""

import numpy as np

from floodsift.llm import language


def test_rare_languages_are_fitted_on_all_their_rows(spark):
    rows = [(k, f"the cat and the other thing number {k}", "en") for k in range(4000)]
    rare = [(9000 + k, f"zaj qux wib {k} vrok", "zz") for k in range(30)]
    table = lambda x: spark.createDataFrame(x, "key long, text string, lang string")
    langs, model = language.fit(table(rows + rare), 200)
    assert langs == ["en", "zz"]
    assert np.allclose(model[:, 1], language.fit(table(rare))[1][:, 0], rtol=1e-12)
