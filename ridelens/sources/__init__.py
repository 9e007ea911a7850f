"""Sources and sinks: file readers/writers, model persistence, SQL entry, fixture views."""
