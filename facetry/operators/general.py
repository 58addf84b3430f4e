"""General measures: sizes, column kinds, class frequencies."""

from __future__ import annotations

from facetry.plans.data import NAN, Data
from facetry.plans.registry import measure


@measure("general", scalar=True)
def attr_to_inst(data: Data):
    """Attributes divided by rows."""
    return len(data.attributes) / data.n if data.n else NAN


@measure("general", scalar=True)
def cat_to_num(data: Data):
    """Categorical divided by numeric attributes."""
    return len(data.categorical) / len(data.numeric) if data.numeric else NAN


@measure("general", supervised=True)
def freq_class(data: Data):
    """Share of rows of each class."""
    total = sum(n for _, n in data.classes)
    return [(c, n / total) for c, n in data.classes]


@measure("general", scalar=True)
def inst_to_attr(data: Data):
    """Rows divided by attributes."""
    return data.n / len(data.attributes) if data.attributes else NAN


@measure("general", scalar=True)
def nr_attr(data: Data):
    """Number of attributes."""
    return len(data.attributes)


@measure("general", scalar=True)
def nr_bin(data: Data):
    """Number of attributes with exactly two values."""
    return sum(k == 2 for k in data.distinct.values())


@measure("general", scalar=True)
def nr_cat(data: Data):
    """Number of categorical attributes."""
    return len(data.categorical)


@measure("general", scalar=True, supervised=True)
def nr_class(data: Data):
    """Number of classes."""
    return len(data.classes)


@measure("general", scalar=True)
def nr_inst(data: Data):
    """Number of rows."""
    return data.n


@measure("general", scalar=True)
def nr_num(data: Data):
    """Number of numeric attributes."""
    return len(data.numeric)


@measure("general", scalar=True)
def num_to_cat(data: Data):
    """Numeric divided by categorical attributes."""
    return len(data.numeric) / len(data.categorical) if data.categorical else NAN
