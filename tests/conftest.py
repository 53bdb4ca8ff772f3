import pytest

from packetloom.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    found = session("tests", "local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_driver_memory="6g", spark_sql_streaming_stateStore_providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
