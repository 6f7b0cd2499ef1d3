"""DataFrame operators of the panel engine (A*, W*, P*, R*, J*, U*)."""
