"""DataFrame -> DataFrame operators, generic over column lists."""
