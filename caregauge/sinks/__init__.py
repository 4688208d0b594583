"""Tables, views and exports."""
