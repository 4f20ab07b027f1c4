"""Labels, bins and phrasings are results: a change of one shows here, as the SQL twins read most of them from the library."""

import hashlib
import importlib
import json

import pytest

DIGESTS = {
    "phrases.PHRASES": "082fc9ca5d72b75a",
    "questions.LAND_USE": "781b6dcdbb867488",
    "questions.HEIGHT": "ebb609f53af89753",
    "questions.ROAD": "474e5c06041a3470",
    "questions.DENSITY": "d05eea74a4dab67a",
    "questions.SURFACE": "056772d9e4f1eb66",
    "questions.SURFACES": "62c64b7056148007",
    "questions.JUNCTION": "648568b2b52b321d",
    "questions.WATER": "9d1e4f85e8ed575a",
    "questions.WATER_FILLER": "b757186213468901",
    "questions.TRANSIT": "d0a2f739543d6755",
    "questions.PARK_YES": "51f7aac4c0634672",
    "questions.PARK_NO": "6efc3dc78cb273c3",
    "questions.AMENITY": "7cd8d5107943659e",
    "questions.DIFFICULTY": "b048b0c7239dd877",
    "rules.RESIDENTIAL_TYPES": "a2f8ba996a55c5c0",
    "rules.INSTITUTIONAL_TYPES": "157d90ee99d27702",
    "rules.COMMERCIAL_TYPES": "cae3f2e4679a4b0b",
    "rules.INDUSTRIAL_TYPES": "523ee9aaeddcda18",
    "rules.COMMERCIAL_AMENITIES": "33bcca62041b254c",
    "rules.BUFFER_M": "fc247a966f78844c",
    "rules.US_BOXES": "313bfcf0e3455093",
    "rules.FR_BOX": "0c9126b97386ccd6",
}


def digest(value):
    return hashlib.sha256(json.dumps(value, ensure_ascii=False).encode()).hexdigest()[:16]


@pytest.mark.parametrize("name", sorted(DIGESTS))
def test_constant(name):
    module, constant = name.split(".")
    value = getattr(importlib.import_module(f"terralens.operators.{module}"), constant)
    assert digest(value) == DIGESTS[name]
    changed = json.loads(json.dumps(value))
    if isinstance(changed, dict):
        changed[next(iter(changed))] = "other"
    else:
        changed = ["other", *changed[1:]]
    assert digest(changed) != DIGESTS[name]
