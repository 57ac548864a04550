"""A stream whose rows grow with the input hands them to files, never to a table in the driver."""

from compare import SF

from tessera.plans import catalog


def test_events_that_are_kept_go_to_files(spark):
    found = catalog.QUERIES["late_data_dropped"](spark, SF)
    assert found.inputFiles()  # none if the rows are in a memory sink
    assert found.first().n_kept == spark.read.parquet(f"{SF}/events.parquet").count()
