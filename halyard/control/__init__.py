"""Optimal control: grids, regressors, dynamic programming, trees, cuts, semi-Lagrangian steps, branching."""
