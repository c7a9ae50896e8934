from ledgerloom.operators import instruments

WANTED = "ordinal long, isin string, symbol string, name string, currency string, kind string, key string, known_id string"
KNOWN = "instrument_id string, isin string, last string"


def resolved(spark, wanted, known, import_id=7):
    rows = [(*w, "clash", "clash") for w in wanted]
    found = instruments.resolve(import_id, spark.createDataFrame(rows, WANTED), spark.createDataFrame([(*k, "clash") for k in known], KNOWN))
    return {r["key"]: (r["instrument_id"], r["created"]) for r in found.by_key.collect()}, {r["instrument_id"]: r for r in found.missing.collect()}


def test_isins_find_known_instruments_and_names_make_new_ones(spark):
    wanted = [(1, "IE1", "A", "World Fund", "EUR", "etf"), (2, "DE2", None, "New Share", "EUR", "stock"), (3, None, None, "Gold Bar", "EUR", "other"), (4, None, "G", "GOLD bar", "USD", "other"), (5, "IE1", "A", "World fund", "EUR", "etf")]
    by_key, missing = resolved(spark, wanted, [("a", "IE1"), ("b", None), ("gold bar", None)])
    assert set(by_key) == {"isin:IE1", "isin:DE2", "name:gold bar"}
    assert by_key["isin:IE1"] == ("a", False) and by_key["isin:DE2"][1] and by_key["name:gold bar"][1]
    assert set(missing) == {by_key["isin:DE2"][0], by_key["name:gold bar"][0]}
    last = missing[by_key["name:gold bar"][0]]
    assert (last["isin"], last["symbol"], last["name"], last["currency"]) == (None, "G", "GOLD bar", "USD")
    assert last.__fields__ == ["instrument_id", "isin", "symbol", "name", "currency", "kind"]


def test_a_repeated_import_makes_the_same_ids_and_another_one_others(spark):
    wanted = [(1, None, None, "Gold", "EUR", "other")]
    first, again, other = (resolved(spark, wanted, [], n)[0]["name:gold"] for n in (1, 1, 2))
    assert first == again and first != other


def test_nulls_ties_and_empty_tables(spark):
    assert resolved(spark, [], [("a", "IE1")]) == ({}, {})
    by_key, missing = resolved(spark, [(None, None, None, None, None, None), (1, None, None, "", "EUR", None), (1, None, None, "", "USD", None), (2, "IE1", None, None, None, None)], [("a", "IE1"), ("b", "IE1")])
    assert by_key["isin:IE1"] == ("b", False) and len(by_key) == 2
    assert missing[by_key["name:"][0]]["currency"] == "USD"
