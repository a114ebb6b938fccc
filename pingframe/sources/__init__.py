"""Sources: text formats, and sonar logs as a Spark data source."""
