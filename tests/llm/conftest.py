import pytest

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def long_text(n, salt=0):
    """n words that do not repeat a run."""
    return " ".join(f"{LONG[(k * k + salt) % 24]}{k + salt * 1_000_003}" for k in range(n))


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and blank texts, one very long text, ties and repeated rows, and columns with the operators' own names."""
    rows = [
        (1, "The cat sat on the mat and looked at the dog by the door.", "en", "a"),
        (1, "The cat sat on the mat and looked at the dog by the door.", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, " \t\n ", "fr", None),
        (5, long_text(40_000), "en", "a"),
        (6, "Größe é中文😀 1234 --- ...", "de", "b"),
        (7, "12345 67 --- !!!", None, "b"),
        (8, "Der Hund und die Katze sind nicht im Haus.", "de", "b"),
        (9, "Le chat est sur la table et le chien dort.", "fr", "c"),
        (10, "x" * 5000, "en", "c"),
        (None, "a text without an id", "en", None),
    ]
    base = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    extra = "rid seeds repeats n_words n_removed score lang_pred key bucket kept component_id n_shingles rule verdict host path own given tail times base c token length offset ids fingerprint".split()
    return base.selectExpr("*", *[f"'x' as {c}" for c in extra])


@pytest.fixture
def none(odd):
    return odd.limit(0)
