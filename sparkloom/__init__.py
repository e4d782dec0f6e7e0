"""sparkloom: a PySpark-native engine for developer-activity and event analytics."""
