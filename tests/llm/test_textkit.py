import pickle

from pyspark import cloudpickle

from strataview.llm import textkit


def test_tables_of_powers_stay_out_of_task_functions_and_go_with_the_task():
    textkit.powers(100_000)
    sent = cloudpickle.dumps(textkit.thrifty(iter))
    assert len(sent) < 10_000
    assert list(pickle.loads(sent)([1, 2])) == [1, 2]
    assert [len(table) for table in textkit._powers] == [1, 1]
    assert [len(table) for table in textkit.powers(3)] == [3, 3]
