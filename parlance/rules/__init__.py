"""Rule data: the fixed values every operator is parameterised with."""
