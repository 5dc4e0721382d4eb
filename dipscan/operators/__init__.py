"""DataFrame operators on catalogues, light curves and scores."""
