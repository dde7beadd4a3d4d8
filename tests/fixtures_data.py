"""Small dirty tables, written out as CSV text.

Fixed values: the known answers in the tests belong to these rows.
"""

SALES = """Fecha,ID_Cliente,Nombre_Cliente,Producto,Cantidad,Precio_Unidad,Canal,Comercial
2026-01-05,CLI-001, Juan Pérez ,Laptop Pro 15,2, 1200.50 €,Web, Carlos Ruiz 
2026-01-05,CLI-001, Juan Pérez ,Laptop Pro 15,2, 1200.50 €,Web, Carlos Ruiz 
06/01/2026,CLI-002,María Gómez,Monitor 4K,1,$350.00,Tienda,Ana Belén
07-01-2026,CLI-003, LUIS MARTINEZ ,Teclado Mecánico,N/A,85.00 €,WEB,Carlos Ruiz
2026/01/08,CLI-004,Ana Belén,Ratón Ergonómico,-1,45.00 €,TIENDA,Ana Belén
invalid_date,CLI-005,Elena Nito,Soporte Monitor,1,25.00 €,Web,Carlos Ruiz
2026-01-10,CLI-006,SOPORTE SA,Pack Cables,5,15.50 €,Tienda,Ana Belén
,,,,,,,
"""

PROFILE_SALES = """Fecha,ID_Cliente,Nombre_Cliente,Producto,Cantidad,Precio_Unidad,Canal,Comercial
2026-01-05,CLI-001, Juan Pérez ,Laptop Pro 15,2, 1200.50 €,Web, Carlos Ruiz 
2026-01-05,CLI-001, Juan Pérez ,Laptop Pro 15,2, 1200.50 €,Web, Carlos Ruiz 
06/01/2026,CLI-002,María Gómez,Monitor 4K,1,$350.00,Tienda,Ana Belén
,CLI-003,Pedro Picapiedra,Teclado Mecanico,3,45.00,WEB,Carlos Ruiz
"""

CONTACT = """Fecha,Campana,ID_Agente,Nombre_Agente,Llamadas_Atendidas,Ventas_Conseguidas,Conversion_Pct,AHT_Segundos,Score_Calidad,Absentismo
2026-02-01, Retencion ,AGT-101, Laura Fernandez ,85,12,14.1%,420,95.5%,No
2026-02-01, Retencion ,AGT-101, Laura Fernandez ,85,12,14.1%,420,95.5%,No
02/02/2026,retencion,AGT-103,Sofia Loren,70,15,21.4%, 510 ,72.0 %,Si
2026-02-04,Soporte Tecnico,AGT-105, Lucia Blanco ,95,5,5.2%, 600 ,105.0%,NO
2026-02-05,Soporte Tecnico,AGT-106,Ramon Sampedro,100,2,2.0%,-50,82.5%,No
"""

PEOPLE = """Fecha_Ingreso,ID_Empleado,Nombre_Empleado,Departamento,Horas_Mes,Productividad_Pct,Salario_Mes,Absentismo_Dias,Evaluacion_Desempeno
2021-03-15,EMP-101,Laura Sánchez,Operaciones,160, 88.5 %, 1850.00 €,0,Excelente
2021-03-15,EMP-101,Laura Sánchez,Operaciones,160, 88.5 %, 1850.00 €,0,Excelente
14/05/2020,EMP-102, CARLOS MENDOZA ,Ventas,N/D,94.0%,$2100.00,-3,Bueno
2019/11/01,EMP-103,Beatriz Lopez,Tecnologia, 150 ,72.0 %,2400.00 €,2,Regular
02-02-2022,EMP-104,Javier Ruiz,Operaciones,165,112.0%,1900.00 €,1,Excelente
invalid_date,EMP-105,Elena Nito,RRHH,140,85.0%,1750.00 €,0,Bueno
2023-06-10,EMP-106,SOPORTE RRHH SL,RRHH,160,90.0%,2000.00 €,0,Excelente
,,,,,,,,
"""

EUROPEAN = """Fecha;Nombre_Empleado;Salario_EUR;Absentismo_Dias
01/02/2026;Ana García;1.200,50 €;2
02/02/2026;LUIS MARTINEZ;2.500,00 €;-3
2026-02-03;Ana García;1.200,50 €;1
"""

ORDERS = """Fecha_Pedido,ID_Pedido,Razon_Social,Region,Unidades_Stock,Descuento_Pct,Importe_Total,Dias_Entrega,Estado_Pedido
2026-04-03,PED-201,Distribuciones Marín S.L.U.,Norte,50,10.0%,1250.00 €,3,Entregado
2026-04-03,PED-201,Distribuciones Marín S.L.U.,Norte,50,10.0%,1250.00 €,3,Entregado
05/04/2026,PED-202, TALLERES ROBLES SLU ,Sur,--,15.5%,$890.50,-2,Pendiente
2026/04/06,PED-203,Comercial Iglesias,Centro, 30 ,8.0 %,640.00 €,5,Entregado
07-04-2026,PED-204,Suministros Del Este,Norte,25,120.0%,410.00 €,1,ENVIADO
invalid_date,PED-205,ALMACENES PARDO S.L.U.,Sur,40,12.0%,975.25 €,4,entregado
2026-04-10,PED-206, Comercial Iglesias ,Centro,60,9.5%,1105.00 €,2,Entregado
2026-04-11,PED-207,Talleres Robles SLU,Sur,15,20.0%,$310.00,0,pendiente
,,,,,,,,
"""

PERCENT = """ID,Cliente,Incidencias_Pct,Descuento_Pct
1,Empresa Alfa,-2.0%,120.0%
2,Empresa Beta,15.5%,-5.0%
3,Empresa Gamma,105.0%,50.0%
4,Empresa Delta,0.0%,100.0%
"""

CAMPAIGNS = """Fecha_Campana,Cod_Campana,Cliente,Canal,Presupuesto,CTR_Pct,Conversiones,Coste_Por_Lead,Estado
2026-07-01,CAM-401,Publicidad Nova S.L.,Redes Sociales,5000.00,3.2,120,12.50,Activa
2026-07-02,CAM-402,Agencia Digital S.A.,Email,2500.00,1.8,45,8.30,Activa
2026-07-03,CAM-403,Ideas Creativas S.L.,Buscadores,7500.00,4.5,210,9.75,Finalizada
2026-07-04,CAM-404,Grupo Marketing Este,Redes Sociales,3200.00,2.9,88,11.20,Activa
2026-07-05,CAM-405,Comercial Rápido S.L.,Display,1800.00,0.9,22,15.60,Pausada
2026-07-06,CAM-406,Publicidad Nova S.L.,Email,4100.00,2.1,67,10.40,Activa
2026-07-07,CAM-407,Agencia Digital S.A.,Buscadores,6300.00,5.1,180,7.90,Finalizada
2026-07-08,CAM-408,Distribuciones Vidal S.L.,Display,2900.00,1.4,39,13.10,Activa
"""

CLAMP = """Nombre_Agente,AHT_Segundos,Score_Calidad
Ramon Sampedro,-50,85.0
Lucia Blanco,450,105.0
"""

SAMPLED = "ID,Nombre,Importe\n1, Juan , 100.50 €\n1, Juan , 100.50 €\n"
