"""Sources and sinks: tables, Markdown folders, audit logs, and the mapping of tables to the engine's model."""
