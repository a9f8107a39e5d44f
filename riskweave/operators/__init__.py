"""DataFrame -> DataFrame operators (cleaning, features, alerts, banks, network, models)."""
