"""The two data sets with known columns and category codes."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Preset:
    features: tuple[str, ...]
    target: str
    codes: dict[str, int]


# Column names and category codes of the two data sets.
IRIS = Preset(
    features=("sepal_length", "sepal_width", "petal_length", "petal_width"),
    target="class",
    codes={"Iris-setosa": 1, "Iris-versicolor": 2, "Iris-virginica": 3},
)
HEADACHE = Preset(
    features=("id", "dos", "age", "airq"),
    target="medication",
    codes={"continuing": 1, "reduced": 2, "none": 3},
)
